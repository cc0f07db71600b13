"""Reading and writing of files: routes, rejects, and buckets that are written again."""

from __future__ import annotations

from pyspark.sql import functions as F

from cantata.sources import files


def test_routes_and_rejects(spark, tmp_path):
    (tmp_path / "sub.dir").mkdir()
    for name, body in {"a.MID": b"\x00\xff", "b.midi": b"M", "c.txt": "MML@é;".encode(), "d.Mmi": b"x", "sub.dir/e.mml": b"y", "f.doc": b"z", "g.txt": b"", "h.txt": b"\xff\xfe", "noext": b"q"}.items():
        (tmp_path / name).write_bytes(body)
    found = files.read_score_files(spark, str(tmp_path))
    got = {r["name"]: (r["route"], bytes(r["content"]) if r["content"] is not None else None, r["text"]) for r in files.accepted(found).collect()}
    assert got == {"a.MID": ("midi", b"\x00\xff", None), "b.midi": ("midi", b"M", None), "c.txt": ("text", None, "MML@é;"), "d.Mmi": ("mmi project", None, "x"), "e.mml": ("mml project", None, "y")}
    assert {r["name"]: r["reason"] for r in files.rejected(found).collect()} == {"f.doc": "unsupported extension", "noext": "unsupported extension", "h.txt": "not UTF-8"}


def test_buckets_are_written_again(spark, tmp_path):
    path = str(tmp_path / "scores")
    scores = spark.createDataFrame([(i, f"MML@c{i},,d;") for i in range(40)], "score_id bigint, text string")
    read = lambda: {r["score_id"]: r["text"] for r in files.read_note_tables(spark, path, "score_id bigint, text string, bucket int").collect()}
    for _ in range(2):
        files.write_scores(scores, path, 4)
    assert read() == {i: f"MML@c{i},d;" for i in range(40)}
    bucket = F.pmod(F.xxhash64("score_id"), F.lit(4))
    one = scores.where(bucket == 2)
    files.write_scores(one.withColumn("text", F.lit("MML@r;")), path, 4)
    changed = {r["score_id"] for r in one.collect()}
    assert 0 < len(changed) < 40 and read() == {i: "MML@r;" if i in changed else f"MML@c{i},d;" for i in range(40)}
