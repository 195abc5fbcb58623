"""The batched sink: attempts, the quota of failures, and a store that an aborted write leaves as it was."""

import os

import pytest

from corvex.sources.sink import put_parquet, read_vectors, write_vectors


def rows_of(spark, ids):
    return spark.createDataFrame([("t", i, [0.0, 0.0] if i % 10 == 9 else [1.0, float(i)]) for i in ids], "tenant string, id long, vector array<double>").coalesce(2)


def test_counts_and_appends(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert read_vectors(spark, path).isEmpty()
    report = write_vectors(rows_of(spark, range(400)), path)
    assert report["rows"] == 360 and report["empty_rows"] == 40 and report["failed_batches"] == 0 and report["batches"] >= 8
    write_vectors(rows_of(spark, range(400, 410)), path)
    assert sorted(r.id for r in read_vectors(spark, path).collect()) == [i for i in range(410) if i % 10 != 9]


def test_a_batch_that_fails_once_is_tried_again(spark, tmp_path):
    marks = tmp_path / "marks"
    marks.mkdir()

    def once(rows, path):
        mark = marks / str(rows[0]["id"])
        if not os.path.exists(mark):
            open(mark, "w").close()
            raise ConnectionError("down")
        put_parquet(rows, path)

    report = write_vectors(rows_of(spark, range(300)), f"file://{tmp_path}/store", once)
    assert report["failed_batches"] == 0 and report["rows"] == 270 and len(os.listdir(marks)) == report["batches"]


def test_quota(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    write_vectors(rows_of(spark, range(100)), path)

    def failing(share):
        def put(rows, to):
            if rows[0]["id"] % 100 < share:
                raise ConnectionError("down")
            put_parquet(rows, to)

        return put

    some = write_vectors(rows_of(spark, range(1000, 2000)), path, failing(40), batch=1)
    assert some["failed_rows"] == 360 and some["failed_batches"] == 360 and some["rows"] == 540
    before = sorted(r.id for r in read_vectors(spark, path).collect())
    files = sorted(os.listdir(tmp_path / "store"))
    with pytest.raises(Exception, match="batches failed"):
        write_vectors(rows_of(spark, range(5000, 6000)), path, failing(80), batch=1)
    assert sorted(r.id for r in read_vectors(spark, path).collect()) == before and sorted(os.listdir(tmp_path / "store")) == files
