import random

import pytest

import corpus_pipeline
from perfloom.llm import similar_texts
from perfloom.llm.simhash import similar_duplicates
from perfloom.llm.similar_texts import shingles

from .cases import empty, nasty, nasty_rows, words
from .test_operators import brute_print


def jaccard(a, b):
    a, b = set(shingles((a or "").encode()).tolist()), set(shingles((b or "").encode()).tolist())
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1) + "x"
    return " ".join(w)


def first_of(docs):
    """doc_id of each row's component's first, by brute force."""
    top = list(range(len(docs)))
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if jaccard(docs[i][1], docs[j][1]) >= 0.8]
    for _ in docs:
        for i, j in pairs:
            top[i] = top[j] = min(top[i], top[j])
    return {docs[i][0]: docs[t][0] for i, t in enumerate(top)}


@pytest.mark.parametrize("block", [4096, 5])
def test_similar_texts(spark, monkeypatch, block):
    monkeypatch.setattr(similar_texts, "BLOCK", block)
    rng = random.Random(21)
    docs = []
    for k in range(4):
        chain = [words(rng, 150)]
        for i in range(12):  # chains and stars of copies around the limit
            chain.append(edited(rng, chain[-1] if k % 2 else chain[0], rng.randrange(1, 7)))
        docs += chain
    menu = words(rng, 60)
    docs += [menu + " " + words(rng, 30) for _ in range(20)]  # a common passage, yet not similar
    docs += [docs[0], docs[1].upper(), "", None, "one two", "one  two\n"]
    docs = list(enumerate(docs))
    got = similar_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == first_of(docs)
    assert all(r.stays == (r.doc_id == r.component_id) for r in got)


def test_similar_texts_nasty(spark):
    assert similar_duplicates(nasty(spark)).count() == len(nasty_rows())
    assert similar_duplicates(empty(spark)).count() == 0


def test_stage_drops_copies_beyond_two_bits(spark, tmp_path):
    rng = random.Random(22)
    base = words(rng, 200)
    copies = [c for c in (edited(rng, base, 4) for _ in range(30)) if jaccard(base, c) >= 0.8 and (brute_print(base) ^ brute_print(c)).bit_count() > 2]
    assert copies
    docs = spark.createDataFrame(list(enumerate([base, *copies, words(rng, 200)])), "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()} == {0, len(copies) + 1}
