"""Fixed schemas of the catalog's tables. What a source leaves out is null."""

DOCUMENTS = "user_id string, pdf_name string, original_filename string, source_type string, source_url string, chunks_count long, status string, created_at timestamp"
CHUNKS = "user_id string, pdf_name string, doc_id long, page_number long, content string, source_url string, page_title string"
MESSAGES = "user_id string, conversation_id long, turn long, role string, content string, sources array<struct<page:long,content_preview:string,source_url:string,score:double>>"
JOBS = "job_id long, user_id string, pdf_name string, status string, stage string, progress double, error string"
