"""Chat formatting with DataFrame functions alone.

The layout of prompt, instruction and message data is told by a fingerprint: the SHA-256 of its
sorted nested field paths, array levels written `[]`. The fingerprint selects a declarative mapping
that turns the layout into canonical turns, an array of (role, text). Tables are recognised by their
schema, and rows of JSON one by one, so one column may mix layouts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = "<|im_start|>", "<|im_end|>\n"
TURNS = "array<struct<role:string,text:string>>"

#: Field paths of a layout, and the turns they give. A turn is a role and the fields whose texts are
#: joined by an empty line, empty ones left out; "each" names an array with the paths of role and text.
#: "roles" has a layout's own names of roles; all other layouts' roles stay as they are.
LAYOUTS = {
    "prompt/response": (("prompt", "response"), [("user", ("prompt",)), ("assistant", ("response",))]),
    "prompt/completion": (("prompt", "completion"), [("user", ("prompt",)), ("assistant", ("completion",))]),
    "question/answer": (("answer", "question"), [("user", ("question",)), ("assistant", ("answer",))]),
    "instruction/output": (("instruction", "output"), [("user", ("instruction",)), ("assistant", ("output",))]),
    "instruction/input/output": (("input", "instruction", "output"), [("user", ("instruction", "input")), ("assistant", ("output",))]),
    "system/instruction/output": (("instruction", "output", "system"), [("system", ("system",)), ("user", ("instruction",)), ("assistant", ("output",))]),
    "messages": (("messages[].content", "messages[].role"), {"each": ("messages", "role", "content")}),
    "conversations": (("conversations[].from", "conversations[].value"), {"each": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant", "model": "assistant", "bot": "assistant"}}),
    "rows": (("conv_id", "role", "text", "turn"), {"rows": ("conv_id", "turn", "role", "text")}),
}


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


FINGERPRINTS = {fingerprint(paths): name for name, (paths, _) in LAYOUTS.items()}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Paths of the leaves of a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def layout_of(schema: T.StructType) -> str:
    """The layout whose fingerprint is that of the schema's paths which occur in some layout.

    Other columns don't count. If the known paths are those of several layouts, the layout with most
    paths that are all there.
    """
    known = {p for paths, _ in LAYOUTS.values() for p in paths}
    there = {p for p in field_paths(schema) if p in known}
    if (name := FINGERPRINTS.get(fingerprint(there))) is not None:
        return name
    whole = [name for name, (paths, _) in LAYOUTS.items() if there.issuperset(paths)]
    if not whole:
        raise ValueError(f"no layout has fields among {sorted(field_paths(schema))}")
    return max(whole, key=lambda name: len(LAYOUTS[name][0]))


def _role(c: Column, names: dict[str, str]) -> Column:
    c = F.coalesce(c.cast("string"), F.lit(""))
    out = c
    for other, own in names.items():
        out = F.when(c == other, own).otherwise(out)
    return out


def _turns(mapping, field, array) -> Column:
    """field(name): a text column; array(name, role, text): an array column of role and text."""
    if isinstance(mapping, dict):
        return F.transform(array(*mapping["each"]), lambda m: F.struct(_role(m["role"], mapping.get("roles", {})).alias("role"), F.coalesce(m["text"], F.lit("")).alias("text")))
    turns = []
    for role, names in mapping:
        text = F.array_join(F.filter(F.array(*(F.coalesce(field(n), F.lit("")) for n in names)), lambda x: x != ""), "\n\n")
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def canonical_turns(df: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """conv_id and turns of a table, by the mapping that its schema's fingerprint selects.

    Layout `rows` has a row for each turn: ordered by turn, then role and text; nulls first. A
    conversation is one row of the result, so its turns meet in one task. Null texts and roles count
    as empty. Rows with a null id form one conversation. Repeated rows are repeated turns.
    """
    name = layout_of(df.schema)
    mapping = LAYOUTS[name][1]
    if name == "rows":
        conv, turn, role, text = (F.col(c) for c in mapping["rows"])
        each = F.struct(turn.alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
        turns = F.transform(F.array_sort(F.collect_list(each)), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
        return df.groupBy(conv.alias("conv_id")).agg(turns.alias("turns"))
    array = lambda a, r, t: F.transform(F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)), lambda m: F.struct(m[r].cast("string").alias("role"), m[t].cast("string").alias("text")))
    return df.select(F.col(id_col).alias("conv_id"), _turns(mapping, lambda n: F.col(n).cast("string"), array).alias("turns"))


def canonical_turns_of_json(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """conv_id, layout and turns of rows of JSON, each by its own fingerprint.

    A row whose fields are no known layout, or which is null or no JSON, has layout and turns null.
    """
    v = F.try_parse_json(F.col(json_col))
    shape = F.schema_of_variant(v)
    # OBJECT<a: STRING, b: ARRAY<OBJECT<c: STRING>>> becomes a,b[c]: the same for all values of a layout.
    for old, new in ((r"ARRAY<OBJECT<", "["), (r">>", "]"), (r"OBJECT<", ""), (r">", ""), (r": ?(?:STRING|VOID|BIGINT|BOOLEAN|DOUBLE|DECIMAL\(\d+, ?\d+\))", ""), (r": \[", "["), (r", ", ",")):
        shape = F.regexp_replace(shape, old, new)
    mark = F.sha2(shape, 256)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, mapping) in LAYOUTS.items():
        if name == "rows":
            continue
        if isinstance(mapping, dict):
            outer = mapping["each"][0]
            text = f"{outer}[{','.join(sorted(p.split('.')[1] for p in paths))}]"
        else:
            text = ",".join(sorted(paths))
        here = mark == hashlib.sha256(text.encode()).hexdigest()

        def array(a, r, t):
            got = F.try_variant_get(v, f"$.{a}", f"array<struct<`{r}`:string,`{t}`:string>>")
            return F.transform(got, lambda m: F.struct(m[r].alias("role"), m[t].alias("text")))

        layout = F.when(here, name).otherwise(layout)
        turns = F.when(here, _turns(mapping, lambda n: F.try_variant_get(v, f"$.{n}", "string"), array)).otherwise(turns)
    return df.select(F.col(id_col).alias("conv_id"), layout.alias("layout"), turns.alias("turns"))


def escape_text(c: Column) -> Column:
    """Every `<|` gets a second bar, so no control string is left, and each `<||` was a `<|`."""
    return F.replace(c, F.lit("<|"), F.lit("<||"))


def unescape_text(c: Column) -> Column:
    return F.replace(c, F.lit("<||"), F.lit("<|"))


def escape_role(c: Column) -> Column:
    """Also keeps a role on its line: a newline becomes `<|n`, which no escaped text holds."""
    return F.replace(escape_text(c), F.lit("\n"), F.lit("<|n"))


def unescape_role(c: Column) -> Column:
    return unescape_text(F.replace(c, F.lit("<|n"), F.lit("\n")))


def format_chat(df: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask of conv_id and turns.

    A turn is `<|im_start|>role\\ntext<|im_end|>\\n` with role and text escaped. The mask is run-length
    encoded over code points, three runs a turn: header (off), text (on for the assistant), end (off).
    Null turns count as none: the empty string.
    """
    turns = F.coalesce(F.col("turns"), F.array().cast(TURNS))
    head = lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))
    formatted = F.array_join(F.transform(turns, lambda t: F.concat(head(t), escape_text(t["text"]), F.lit(END))), "")
    run = lambda n, on: F.struct(n.cast("int").alias("length"), on.alias("on"))
    off = F.lit(False)
    mask = F.flatten(F.transform(turns, lambda t: F.array(run(F.length(head(t)), off), run(F.length(escape_text(t["text"])), t["role"] == "assistant"), run(F.lit(len(END)), off))))
    return df.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_chat(df: DataFrame) -> DataFrame:
    """The rows of format_chat() with turns and loss_texts (the unescaped texts under the mask), read back."""
    blocks = F.slice(F.split("formatted", r"<\|im_end\|>\n"), F.lit(1), (F.size("loss_mask") / 3).cast("int"))
    head = lambda i: F.element_at("loss_mask", 3 * i + 1)["length"]
    role = lambda b, i: unescape_role(F.substring(b, F.lit(len(START) + 1), head(i) - len(START) - 1))
    text = lambda b, i: unescape_text(F.substring(b, head(i) + 1, F.element_at("loss_mask", 3 * i + 2)["length"]))
    turns = F.transform(blocks, lambda b, i: F.struct(role(b, i).alias("role"), text(b, i).alias("text")))
    out = df.withColumn("turns", turns)
    on = lambda t, i: F.element_at("loss_mask", 3 * i + 2)["on"]
    return out.withColumn("loss_texts", F.transform(F.filter("turns", on), lambda t: t["text"]))


def chat_digest(read: DataFrame) -> DataFrame:
    loss = F.array_join("loss_texts", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
