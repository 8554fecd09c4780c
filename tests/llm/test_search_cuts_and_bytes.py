"""Ranked search, fill-in-the-middle and byte-level BPE against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from perfloom.llm import byte_bpe, fill_in_middle, ranked_search
from perfloom.llm.token_counts import tokenizer_path

from .cases import empty, nasty, nasty_rows, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}

# ranked search


def ranked(docs, items, k=50):
    """{(item_id, text): [(rank, doc_id, score)]} by scoring every document."""
    bags = [(i, b) for i, t in docs if (b := Counter(TERM.findall((t or "").translate(LOWER))))]
    n_docs, n_terms, df = len(bags), sum(sum(b.values()) for _, b in bags), Counter(t for _, b in bags for t in b)
    out = {}
    for item in set(items):
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(TERM.findall((item[1] or "").translate(LOWER))) if t in b)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out[item] = [(r, None if no else i, -s) for r, (s, no, i) in enumerate(sorted(scored)[:k], 1)]
    return {i: x for i, x in out.items() if x}


def got_ranks(df):
    out = {}
    for r in df.collect():
        out.setdefault((r.item_id, bytes(r.text).decode()), []).append((r["rank"], r.doc_id, r.score))
    return {i: sorted(x) for i, x in out.items()}


ITEMS = [(1, "the quick brown fox"), (1, "another text"), (2, None), (3, ""), (4, "ÜBER Straße 日本語 0 1 2"), (5, "zzz qqq"), (None, "one ONE intro")]


def test_ranked_search_of_odd_rows(spark):
    docs = [(r[0], r[1]) for r in nasty_rows()]
    items = [*ITEMS, ITEMS[0], (6, docs[5][1]), (7, docs[13][1][:300])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = ranked(docs, [(i, t or "") for i, t in items])
    assert any(len(x) > 3 for x in want.values())
    for shard_bytes, query_bytes in ((1 << 20, 1 << 20), (200, 60)):
        assert got_ranks(ranked_search.rank_documents(nasty(spark), table, shard_bytes=shard_bytes, query_bytes=query_bytes)) == want
    assert ranked_search.rank_documents(empty(spark), table).count() == 0
    assert ranked_search.rank_documents(nasty(spark), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_ranked_search_keeps_ties_in_order(spark):
    rng = random.Random(3)
    docs = [(i, "copy of one text" if i % 3 == 0 else words(rng, 20, "abcd")) for i in range(600)]
    items = [(1, "one text"), (2, "a b c d copy ab cd"), (3, words(rng, 30, "abcd"))]
    want = ranked(docs, items, 7)
    assert [i for _, i, _ in want[1, "one text"]] == [0, 3, 6, 9, 12, 15, 18]
    index = ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_docs=40)
    table = spark.createDataFrame(items, "item_id long, text string").select("item_id", F.col("text").cast("binary").alias("text"))
    for pilot in (1, 4, 1 << 20):
        assert got_ranks(ranked_search.search(index, table, 7, pilot=pilot)) == want


def test_max_score_leaves_out_only_what_cannot_qualify():
    rng = np.random.default_rng(4)
    probed = 0
    for _ in range(200):
        lists, size, k = [], 300, int(rng.integers(1, 12))
        for _ in range(int(rng.integers(1, 9))):
            places = np.sort(rng.choice(size, int(rng.integers(1, size)), replace=False)).astype(np.uint32)
            impacts = rng.integers(0, 50, len(places))
            lists.append((int(rng.integers(0, 9)), places, impacts, int(impacts.max())))
        score = np.zeros(size, np.int64)
        for w, places, impacts, _ in lists:
            score[places] += w * impacts
        held, mine = ranked_search.max_score(lists, size, k, 0)
        assert (score[held] == mine).all()
        least = max(np.sort(score)[-k], 1)
        assert set(np.flatnonzero(score >= least)) <= set(held.tolist())
        probed += len(held) < np.count_nonzero(score)
    assert probed > 100


# fill-in-the-middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_fim(doc_id, text):
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[i : i + 8], 16) for i in range(0, 32, 8)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle(spark):
    rng = random.Random(8)
    odd = ["a<P>b", "<S", "x<M", "<>", "<M", "P>P>S>", "<<S", "日本語a𝄞b\n\n c", "\r\n\t", "A" * 5000, "é" * 3000, "ab" * 40_000 + "é" + "cd" * 40_000, "Zé9" * 30_000]
    rows = [(r[0], r[1]) for r in nasty_rows()] + [(100 + i, t) for i, t in enumerate(odd)]
    rows += [(1000 + i, "".join(rng.choice("ab <>PSM\né日𝄞") for _ in range(rng.randrange(40)))) for i in range(400)]
    want = sorted(((i, *plain_fim(i, t or ""), t or "") for i, t in rows), key=repr)
    out = fill_in_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), every=7)
    got = out.withColumn("text", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle.fill_in_middle(nasty(spark)).count() == len(nasty_rows())
    assert fill_in_middle.fill_in_middle(empty(spark)).count() == 0


@pytest.mark.parametrize("every,block", [(1, 3), (4, 7), (256, 1 << 16)])
def test_unit_index_finds_every_unit(every, block):
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("abZ é日𝄞\n") for _ in range(rng.randrange(60)))
        index = fill_in_middle.UnitIndex(text.encode(), every, block)
        units = UNIT.findall(text)
        assert (index.n, index.chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert index.locate(k) == (len(before.encode()), len(before))
        assert len(index.units) == len(index.byte_at) == len(index.char_at) == -(-index.n // every)


# byte-level BPE


def library():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_the_library_and_decodes(spark):
    lib, rng = library(), random.Random(6)
    odd = ["  two  spaces \n\n end  ", "it's WE'LL 'S ''d", "\x1c\x85  x", "áẞßİı", "\0\x01", "😀👩‍👩‍👧 👍🏽", "한국어 텍스트와 русский текст العربية", "<|endoftext|>", " " * 700, "\n" * 300 + "x", "0123456789" * 80, "=" * 900, "ab" * 300]
    odd += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß日") for _ in range(rng.randrange(1, 1500))) for _ in range(40)]
    odd += ["".join(rng.choice(["a", " ", "\n", "'", "t", "1", "é", "!", "the", "ing"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(r[0], r[1]) for r in nasty_rows()] + [(100 + i, t) for i, t in enumerate(odd)]
    out = byte_bpe.decode_ids(byte_bpe.encode_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))).collect()
    got = sorted(((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in out), key=repr)
    ids = [(i, np.asarray(lib.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows]
    assert got == sorted(((i, len(x) // 4, x, t) for i, x, t in ids), key=repr)
    assert byte_bpe.encode_texts(empty(spark)).count() == 0
    assert byte_bpe.encode_texts(nasty(spark)).count() == len(nasty_rows())
    none = byte_bpe.decode_ids(spark.createDataFrame([(None,)], "ids binary")).first()
    assert none.decoded is None


def test_byte_bpe_of_awkward_ranks():
    """Ranks where a merge makes a pair of lower rank, so merges of one pair must not run ahead."""
    rng = random.Random(9)

    def merge(ranks, piece):
        parts = [bytes([b]) for b in piece]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], math.inf))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [ranks[p] for p in parts]

    for trial in range(60):
        tokens = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 6))) for _ in range(rng.randrange(1, 60))}
        order = [bytes([b]) for b in range(256)] + sorted(tokens)
        rng.shuffle(order)
        ranks = {t: i for i, t in enumerate(order)}
        encoder = byte_bpe.Encoder(ranks, r"\S+|\s")
        pieces = ["".join(rng.choice("abc") for _ in range(n)) for n in (2, 3, 5, 9, 17, 40, 100, 255, 256, 257, 600)]
        pieces += ["a" * n for n in (2, 7, 256, 301)]
        got = encoder.pieces({p for p in pieces if p.encode() not in ranks})
        for p, ids in got.items():
            assert np.frombuffer(ids, "<u4").tolist() == merge(ranks, p.encode()), (trial, p)
    with pytest.raises(ValueError):
        byte_bpe.Encoder({b"a": 0}, ".")


def test_byte_bpe_of_long_texts_and_a_full_memory(spark, monkeypatch):
    lib, rng = library(), random.Random(1)
    encoder = byte_bpe.Encoder(lib._mergeable_ranks, lib._pat_str)
    monkeypatch.setattr(byte_bpe, "MEMO", 50)
    monkeypatch.setattr(byte_bpe, "TAKEN", 1000)
    for text in (words(rng, 3000), words(rng, 20), "x" * 20_000 + " " + words(rng, 900, "日本語テキスト")):
        assert np.frombuffer(encoder.encode_all([text])[0], "<u4").tolist() == lib.encode_ordinary(text)
    assert len(encoder.memo) <= 2000
