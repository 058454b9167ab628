"""Streams that are stopped, replayed and fed again."""

from pathlib import Path

from pyspark.sql import functions as F

from ledgerleaf.operators.index import IndexLog
from ledgerleaf.streaming import streams


def test_index_log_replays_and_restarts(spark, tmp_path):
    folder, log = tmp_path / "in", IndexLog(spark, f"file://{tmp_path}/log", "id long, h string", "id", "h")
    schema = "id long, h string, deleted boolean"

    def put(name, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(folder / name))

    def go(sync=log.sync):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(f"{folder}/*")
        streams.index_stream(s, sync, f"{tmp_path}/check").awaitTermination()

    state = lambda: {(r.id, r.h) for r in log.current().collect()}
    put("a", (1, "x", False), (2, "y", None), (2, "y", None))
    go()
    assert state() == {(1, "x"), (2, "y")}
    put("b", (2, "z", False), (1, "x", False), (3, "w", False), (9, "q", True))
    calls = []

    def fails(df, n):
        log.sync(df, n)
        calls.append(n)
        raise RuntimeError("lost after writing")

    try:
        go(fails)
    except Exception as e:  # the stream's own error type
        assert "lost after writing" in str(e)
    assert calls == [1] and state() == {(1, "x"), (2, "z"), (3, "w")}
    go()  # the batch is replayed: the same rows in the same folder
    assert state() == {(1, "x"), (2, "z"), (3, "w")}
    assert {(r.id, r.batch) for r in log.log().collect()} == {(1, 0), (2, 0), (2, 1), (3, 1)}
    put("c", (2, None, True))
    go()
    assert state() == {(1, "x"), (3, "w")}


def test_uploads_are_accepted_or_refused_with_a_reason(spark, tmp_path):
    inbox = tmp_path / "inbox" / "deep"
    inbox.mkdir(parents=True)
    for name, body in (("a.txt", b"hello"), ("B.TXT", b"x" * 10), ("big.txt", b"x" * 101), ("c.exe", b"no"), ("none", b"no"), ("d.docx", b"")):
        (inbox / name).write_bytes(body)

    def go():
        streams.upload_stream(spark, str(tmp_path / "inbox"), str(tmp_path / "out"), str(tmp_path / "check"), cap=100).awaitTermination()
        read = lambda x: spark.read.parquet(str(tmp_path / "out" / x)).withColumn("name", F.element_at(F.split("path", "/"), -1)).collect()
        return {r.name: bytes(r.content) for r in read("accepted")}, {r.name: r.reason for r in read("refused")}

    accepted, refused = go()
    assert accepted == {"a.txt": b"hello", "B.TXT": b"x" * 10}
    assert refused == {"big.txt": "too_large", "c.exe": "unsupported_type", "none": "unsupported_type"}
    (inbox / "later.pdf").write_bytes(b"%PDF")
    accepted, refused = go()
    assert set(accepted) == {"a.txt", "B.TXT", "later.pdf"} and len(refused) == 3
    assert Path(tmp_path / "out" / "accepted").is_dir()
