import random

from pyspark.sql import functions as F

import corpus_pipeline

from .cases import nasty_rows, words
from .test_operators import WORD, brute_print, check_pieces

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, tmp_path):
    rng = random.Random(12)
    items = [(i, words(rng, 30)) for i in range(5)]
    docs = [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in nasty_rows()]
    menu = "\n".join(words(rng, 9) for _ in range(4))
    for i in range(200, 320):
        t = words(rng, 50)
        t = f"{menu}\n{t}" if i % 5 == 0 else f"{t} {items[i % 5][1]} {t[:40]}" if i % 11 == 0 else t
        docs.append((i, t.upper().replace(" ", "!! ") if i % 7 == 0 else t, "en", f"src{i % 3}", len(t)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 != 0), 0) for i in range(200, 320, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return items


def test_stages(spark, tmp_path):
    items = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        out = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == COLUMNS
        if name == "quality classifier":
            bad = {r.doc_id for r in before if r.doc_id is not None and r.doc_id >= 200 and r.doc_id % 7 == 0}
            assert not bad & {r.doc_id for r in after}
            assert {r.doc_id for r in before if r.doc_id is not None and r.doc_id >= 200} - bad <= {r.doc_id for r in after}
        elif name == "line dedup":
            seen, want = set(), {}
            for r in sorted({(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in before if r.doc_id is None or r.doc_id >= 200}):
                lines = r[1].split("\n")
                full = [k for k, x in enumerate(lines) if WORD.search(x)]
                gone = set()
                for j in range(len(full) - 2):
                    key = tuple(lines[k] for k in full[j : j + 3])
                    gone |= set(full[j : j + 3]) if key in seen else set()
                    seen.add(key)
                want[r[0]] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
            assert len(after) == len(before)
            assert {r.doc_id: r.text for r in after if r.doc_id is not None and r.doc_id >= 200} == {k: v for k, v in want.items() if k >= 200}
            assert all(r.n_chars == len(r.text) for r in after if r.text is not None)
        elif name == "SimHash near-dedup":
            prints = [brute_print(r.text) for r in after]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
            left = {r.doc_id for r in after}
            assert all(any((brute_print(r.text) ^ p).bit_count() <= 2 for p in prints) for r in before if r.doc_id not in left and brute_print(r.text) == 0)
        elif name == "benchmark decontamination":
            hit = {r.doc_id for r in before if any(t in (r.text or "") for _, t in items)}
            assert hit and {r.doc_id for r in after} == {r.doc_id for r in before} - hit
        else:
            check_pieces(after, [(r.doc_id, r.text) for r in before])
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == docs.agg(F.sum("length")).first()[0]


CLASHES = ["_row", "_id", "_th", "_text", "_n", "__id", "__th", "__n", "h", "cls", "n", "top", "keep", "count", "fp", "host", "path", "_lines", "_full", "_gone", "start", "length", "ids"]


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({c: F.lit(7) for c in CLASHES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/clash-{name.replace(' ', '-')}")
        docs = spark.read.parquet(f"{tmp_path}/clash-{name.replace(' ', '-')}")
        assert docs.where(" and ".join(f"`{c}` = 7" for c in CLASHES)).count() == docs.count() > 0
    check_pieces(corpus_pipeline.packing(spark, docs, str(tmp_path)).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_stages_take_an_empty_table(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_stages_on_null_and_repeated_rows(spark, tmp_path):
    """Null texts are empty ones; of rows equal in id and text near-dedup leaves one, the other stages treat them alike."""
    corpus(spark, tmp_path)
    rows = [(1, None), (2, ""), (None, "one of its own kind"), (None, "one of its own kind"), (5, "other words than those"), (5, "other words than those")]
    docs = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = lambda name: sorted(((r.doc_id, r.text) for r in dict(corpus_pipeline.STAGES)[name](spark, docs, str(tmp_path)).collect()), key=repr)
    assert got("line dedup") == got("benchmark decontamination") == sorted(rows, key=repr)
    assert got("SimHash near-dedup") == sorted([(1, None), (None, "one of its own kind"), (5, "other words than those")], key=repr)
