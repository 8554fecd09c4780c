import collections
import math
import random

from perfloom.llm import lm_scoring

from .cases import nasty, nasty_rows, words


def spelled(text, order):
    s = b"\x0b" * order + b" ".join((text or "").encode().lower().split()) + b"\n"
    return [s[i - order : i + 1] for i in range(order, len(s))]


def brute_log10(gram, counts):
    """PPM by method C straight from counts of all suffixes."""
    out, shut = 0.0, set()
    for k in range(len(gram)):
        here = counts.get(gram[k:-1], {})
        if not here:
            continue
        left = {s: n for s, n in here.items() if s not in shut}
        total = sum(left.values()) + len(left)
        if gram[-1] in left:
            return out + math.log10(left[gram[-1]] / total)
        if left:
            out += math.log10(len(left) / total)
        shut |= set(here)
    return out - math.log10(256 - len(shut))


def trie(docs, order):
    counts = collections.defaultdict(collections.Counter)
    for i, t in docs:
        if not lm_scoring.held_out(i):
            for g in spelled(t, order):
                for k in range(len(g)):
                    counts[g[k:-1]][g[-1]] += 1
    return counts


def check(spark, docs, order, **kw):
    counts = trie(docs, order)
    got = lm_scoring.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), order=order, **kw).collect()
    want = sorted((str(i), round(sum(brute_log10(g, counts) for g in spelled(t, order)), 6)) for i, t in docs)
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == want


def test_whole_documents_against_brute_force(spark, monkeypatch):
    check(spark, [(r[0], r[1]) for r in nasty_rows()], 5, grams=200, words=40)
    monkeypatch.setattr(lm_scoring, "PIECE", 50)
    monkeypatch.setattr(lm_scoring, "FLUSH", 20)
    check(spark, [(r[0], (r[1] or "")[:900]) for r in nasty_rows()], 2, grams=200)
    check(spark, [(r[0], (r[1] or "")[:900]) for r in nasty_rows()], 5)


def test_probabilities_add_up(spark):
    """After some contexts, seen and unseen ones, all 256 symbols together have probability one."""
    rng = random.Random(31)
    docs = [(i, words(rng, 30, "abc")) for i in range(30)]
    counts = trie(docs, 3)
    heads = [b"abc", b"b a", b"zzz", b"za ", b"\x0b\x0b\x0b"]
    grams = [h + bytes([s]) for h in heads for s in range(256)]
    known = collections.Counter(g for i, t in docs if not lm_scoring.held_out(i) for g in spelled(t, 3))
    rows = [(int.from_bytes(g, "big"), known[g]) for g in {*grams, *known}]
    got = {r.gram: r.score for r in lm_scoring.gram_scores(spark.createDataFrame(rows, "gram long, n long"), 3).collect()}
    assert len(got) == len(rows)
    for h in heads:
        assert math.isclose(sum(10 ** got[int.from_bytes(h + bytes([s]), "big")] for s in range(256)), 1.0)
    assert all(math.isclose(got[int.from_bytes(g, "big")], brute_log10(g, counts)) for g in grams)


def test_word_order_counts(spark):
    rng = random.Random(32)
    base = words(rng, 400)
    held = next(i for i in range(100, 200) if lm_scoring.held_out(i))
    docs = [(i, base) for i in range(10)]
    score = lambda t: {r.doc_id: r.score for r in lm_scoring.score_documents(spark.createDataFrame([*docs, (held, t)], "doc_id long, text string")).collect()}[held]
    assert score(base) > score(" ".join(reversed(base.split()))) + 50


def test_rare_contexts_count(spark):
    """Nodes far below a share of 2^-19 of all symbols are still in the model."""
    ids = [i for i in range(30) if not lm_scoring.held_out(i)][:2] + [next(i for i in range(30) if lm_scoring.held_out(i))]
    texts = ["the " * 140_000 + "zebra", "quokka Zebu", "zebra quokkas unseen"]
    check(spark, list(zip(ids, texts, strict=True)), 5)


def test_table_finds_all():
    import numpy as np

    rng = np.random.default_rng(33)
    keys = np.unique(rng.integers(0, 1 << 48, 5000))
    table = lm_scoring.Table(keys)
    assert (table.find(keys) == np.arange(len(keys))).all()
    other = np.setdiff1d(rng.integers(0, 1 << 48, 5000), keys)
    assert (table.find(np.append(other, 0)) == -1).all()
    assert (lm_scoring.Table(np.zeros(0, np.int64)).find(other) == -1).all()


def test_nasty_rows_all_come_back(spark):
    assert lm_scoring.score_documents(nasty(spark), grams=10).count() == len(nasty_rows())
