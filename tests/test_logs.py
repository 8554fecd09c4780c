import os
import random

import pytest
from pyspark.sql import functions as F

from perfloom.operators import parsers
from perfloom.sources import logs, readers

TEXTS = [b"", b"\n", b"one", b"one\n", b"\n\n\n", b"a\nbb\n\nccc", "é日本\nx𝄞\r\n".encode() * 50, b"long " * 900 + b"\nend", b"bad \xff\xfe bytes\n" * 3]


def rows_of(body):
    out, at = [], 0
    parts = body.split(b"\n")
    for line in parts if parts[-1] else parts[:-1]:
        out.append((at, line.decode("utf-8", "replace")))
        at += len(line) + 1
    return out


def read(parts):
    return [(s, x) for p in parts for b in logs.lines(p) for s, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_ranges_and_tails(tmp_path, monkeypatch, block):
    monkeypatch.setattr(logs, "BLOCK", block)
    for body in [t for t in TEXTS if block > 3 or len(t) < 100]:
        p = tmp_path / "a.log"
        p.write_bytes(body)
        want = rows_of(body)
        for split in (1, 2, 5, 64, 1 << 20):
            if split > 2 or len(body) < 300:
                assert read(logs.ranges(str(p), 0, len(body), split)) == want
        for n in (1, 2, 3, 100):
            assert read([logs.Part(str(p), 0, len(body), n)] if body else []) == want[-n:]


def test_source_reads_folders_patterns_and_newest(spark, tmp_path):
    rng = random.Random(1)
    want = {}
    for i in range(5):
        body = b"".join(f"{i} {rng.random()} {'ERROR' if j % 7 == 0 else 'ok'}\n".encode() for j in range(rng.randrange(50, 900)))
        (tmp_path / f"n{i}.log").write_bytes(body)
        os.utime(tmp_path / f"n{i}.log", (1000 + i, 1000 + i))
        want[f"n{i}.log"] = [x for _, x in rows_of(body)]
    (tmp_path / "other.txt").write_text("no log\n")
    got = {}
    for r in readers.log_lines(spark, f"{tmp_path}/*.log", newest=3).orderBy("file", "pos").collect():
        got.setdefault(r.file, []).append(r.line)
    assert got == {k: want[k] for k in ("n2.log", "n3.log", "n4.log")}
    split = spark.read.format("perfloom-log").option("split", 1000).load(str(tmp_path))
    assert split.count() == sum(map(len, want.values())) + 1 and split.rdd.getNumPartitions() > 10
    last = readers.log_lines(spark, f"file://{tmp_path}/*.log", tail=20)
    found = parsers.error_lines(last, "file", "line", "pos", window=500, n=2)
    assert {(r.file, r.line) for r in found.collect()} == {(f, x) for f in ("n2.log", "n3.log", "n4.log") for x in [y for y in want[f][-20:] if "ERROR" in y][-2:]}
    assert readers.log_lines(spark, f"{tmp_path}/*.none").count() == 0


def test_tail_of_a_log_of_gigabytes_reads_only_its_end(spark, tmp_path):
    """A file of 3 GB, nearly all of it a hole: as one row it couldn't be read at all."""
    with open(tmp_path / "big.log", "wb") as f:
        f.truncate(3 << 30)
        f.seek(0, 2)
        f.write(b"".join(b"\nline %d" % i for i in range(600)) + b"\n")
    got = readers.log_lines(spark, str(tmp_path / "big.log"), tail=500).orderBy("pos").collect()
    assert [r.line for r in got] == [f"line {i}" for i in range(100, 600)] and got[0].pos > 3 << 30


def test_growing_logs_are_a_stream(spark, tmp_path):
    spark.dataSource.register(logs.LogSource)
    folder, out = tmp_path / "logs", tmp_path / "out"
    folder.mkdir()
    stream = spark.readStream.format("perfloom-log").option("split", 16).load(f"{folder}/*.log")

    def run():
        q = stream.where(F.length("line") > 0).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-state").trigger(once=True).start()
        q.awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(logs.SCHEMA).parquet(str(out)).collect())

    (folder / "a.log").write_bytes(b"one\ntwo\nunfin")
    assert run() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    with open(folder / "a.log", "ab") as f:
        f.write(b"ished line of some length\n")
    (folder / "b.log").write_bytes(b"other\n")
    more = run()
    assert more == [("a.log", 0, "one"), ("a.log", 4, "two"), ("a.log", 8, "unfinished line of some length"), ("b.log", 0, "other")]
    (folder / "b.log").write_bytes(b"new\n")  # rotated
    assert run() == sorted([*more, ("b.log", 0, "new")])
