import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from perfloom.llm import decontamination, lm_scoring, packing, quality_rules, simhash, suffix_dedup, url_filters
from perfloom.llm.line_dedup import dedup_lines
from perfloom.llm.quality_classifier import classify
from perfloom.llm.token_counts import count_tokens, tokenizer_path

from .cases import empty, nasty, nasty_rows, words

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rows_of(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


# packing


def check_pieces(got, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    ids = [(i, np.asarray([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes()) for i, x in docs]
    assert sum(r["length"] for r in got) * 4 == sum(len(b) for _, b in ids)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in got)
    want = collections.Counter((i, len(b) // 4) for i, b in ids)
    have = collections.Counter()
    bodies = collections.defaultdict(list)
    for i, b in ids:
        bodies[i, len(b) // 4].append(b)
    for r in got:
        assert any(zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"] for b in bodies[r["doc_id"], r["doc_tokens"]])
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert have == {k: n * k[1] for k, n in want.items()}
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    return sequences


def test_packing_round_trip(spark):
    docs = [(r[0], r[1]) for r in nasty_rows()]
    for ranked in (100_000, 3):
        check_pieces(packing.pack_documents(nasty(spark), ranked=ranked).collect(), docs)
    places = ["doc_id", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows_of(packing.pack_documents(nasty(spark), ids=False), *places) == rows_of(packing.pack_documents(nasty(spark)), *places)
    assert packing.pack_documents(empty(spark)).count() == 0


def test_packing_leaves_little_padding():
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2048, 5000), np.full(3000, 1500), rng.integers(1025, 2048, 2000)):
        hist = np.bincount(lengths, minlength=2048)
        p = packing.plan(hist)
        used = int(lengths.sum()) - p["total"]
        assert p["sequences"] * 2048 - used <= 0.02 * lengths.sum()
        for g in range(1, 257):  # places of a length are gapless from rank 0
            seg = p["seg"][p["seg"][:, 0] == g]
            assert len(seg) == 0 or (seg[0, 1] == 0 and (seg[1:, 1] == seg[:-1, 2]).all())


def test_nnls_matches_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, b = rng.random((6, 4)), rng.normal(size=6)
        x = packing.nnls(a, b)
        best = min(np.linalg.norm(a[:, list(s)] @ z - b) for k in range(5) for s in __import__("itertools").combinations(range(4), k) if (z := np.linalg.lstsq(a[:, list(s)], b, rcond=None)[0]).min(initial=0) >= 0)
        assert np.linalg.norm(a @ x - b) <= best + 1e-6


# token counts


def test_token_counts_and_cache(spark, tmp_path):
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    cache = f"file://{tmp_path}/cache"
    want = sorted(((r[0], len((r[1] or "").encode()), len(m.encode(r[1] or "")), len(m.encode(r[1] or "")) > 4096) for r in nasty_rows()), key=repr)
    for _ in range(2):
        assert rows_of(count_tokens(nasty(spark), cache=cache), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({r[1] or "" for r in nasty_rows()})
    assert count_tokens(empty(spark)).count() == 0


def test_token_counts_come_from_the_cache(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    spark.conf.set("spark.perfloom.tokenCache", cache)
    try:
        docs = spark.createDataFrame([(1, "some text"), (2, "more")], "doc_id long, text string")
        assert count_tokens(docs).count() == 2
        stored = spark.read.parquet(cache).withColumn("n_tokens", F.lit(77).cast("long")).collect()
        spark.createDataFrame(stored, "digest binary, tokenizer string, n_tokens long").write.mode("overwrite").parquet(cache)
        more = spark.createDataFrame([(1, "some text"), (2, "more"), (3, "")], "doc_id long, text string")
        assert rows_of(count_tokens(more), "doc_id", "n_tokens") == [(1, 77), (2, 77), (3, 0)]
    finally:
        spark.conf.unset("spark.perfloom.tokenCache")


def test_the_query_encodes_nothing_twice(spark, monkeypatch):
    """The registered query looks texts up in the cache that its first run left in the shared folder."""
    from perfloom.llm import queries, token_counts

    sf = "/root/testdata/sf0.001"
    shared = f"{token_counts.shared_dir(spark)}/once-{os.getpid()}"
    monkeypatch.setattr(token_counts, "shared_dir", lambda spark: shared)
    first = rows_of(queries.op2_token_counts(spark, sf), "doc_id", "n_tokens")
    cache = f"{shared}/perfloom/token-cache/{token_counts.tokenizer_digest(tokenizer_path('piece_bpe_32k.model'))}"
    n = spark.read.parquet(cache).count()
    assert n == spark.read.parquet(f"{sf}/documents.parquet").select("text").distinct().count()
    assert rows_of(queries.op2_token_counts(spark, sf), "doc_id", "n_tokens") == first
    assert spark.read.parquet(cache).count() == n


# URL rules


@pytest.mark.parametrize("small", [10_000, 2])
def test_url_rules(spark, monkeypatch, small):
    monkeypatch.setattr(url_filters, "SMALL", small)
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("block", "net", "/de/"), ("block", "", ""), ("block", "a.b", "/x"), ("allow", "a.b", "/x")]
    urls = ["http://x.Example.COM/en/71?q#f", "https://example.com/en/6", "http://notexample.com/en/7", "net", None, "", "a://", "x://net/de/1://y", "x://a.b/xy", "x://a.b/xy", "x://b/x", "x://NET/de", "http://n.net/de/#"]

    def judge(u):
        u = u or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match("[^/?#]*", rest)[0].translate(LOWER)
        path = re.match("[^?#]*", rest[len(host) :])[0]
        fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p) and (h or not host)]
        return (host, path, max(fit)[3] if fit else None, max(fit)[2] if fit else "allow")

    names = "page_id long, url string, host string, path string, rule int, verdict string, _n int, _short string, _best string"
    pages = spark.createDataFrame([(i % 11, u, "h", "p", 1, "v", 2, "s", "b") for i, u in enumerate(urls)], names)
    got = rows_of(url_filters.judge_urls(pages, spark.createDataFrame(rules, url_filters.RULES)), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted(((i % 11, *judge(u)) for i, u in enumerate(urls)), key=repr)
    assert url_filters.judge_urls(pages.where("false"), spark.createDataFrame(rules, url_filters.RULES)).count() == 0
    assert {r.verdict for r in url_filters.judge_urls(pages, spark.createDataFrame([], url_filters.RULES)).collect()} == {"allow"}


def test_url_query_judges_by_the_rules_of_its_contract(spark, tmp_path):
    """Each rule on its host, a subdomain and another host, with the verdict of the contract."""
    from perfloom.llm import queries

    cases = [("com", "/en/1", "com/en/", "block"), ("www.example.com", "/en/71", "example.com/en/7", "allow"), ("net", "/de/1", "net/de/", "allow"), ("a.net", "/de/8", "net/de/", "allow"), ("example.net", "/de/7", "net/de/", "allow"), ("example.net", "/de/8", "example.net/de/8", "block"), ("b.Example.net", "/de/89", "example.net/de/8", "block"), ("x.org", "/es/", "org/es/", "block"), ("notnet", "/de/8", None, "allow")]
    spark.createDataFrame([(i, f"https://{h}{p}?q") for i, (h, p, _, _) in enumerate(cases)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = rows_of(queries.op3_url_filters(spark, str(tmp_path)), "page_id", "rule", "verdict")
    assert got == sorted(((i, r, v) for i, (_, _, r, v) in enumerate(cases)), key=repr)


# LM scoring


def test_lm_base_and_score(spark):
    docs = [(r[0], r[1]) for r in nasty_rows()]
    tokens = [[*WORD.findall((t or "").translate(LOWER)), None] for _, t in docs]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 7 == 2 for i, _ in docs]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    got = rows_of(lm_scoring.score_documents(nasty(spark), words=40), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    base = [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) for t in tokens]
    want = sorted([(i, h, len(t), sum(c[w] > 0 for w in t), n, b) for (i, _), h, t, b in zip(docs, held, tokens, base, strict=True)], key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want])
    assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)
    assert lm_scoring.score_documents(empty(spark)).count() == 0


# benchmark decontamination


def test_decontamination(spark):
    rng = random.Random(3)
    items = [(i, ". ".join(words(rng, rng.randrange(8, 40), "abcdefghijkl").capitalize() for _ in range(2)) + ".") for i in range(60)]
    docs = [(i, words(rng, rng.choice([5, 100, 900]), "abcdefghijkl")) for i in range(60)]
    want = set()
    for i in range(0, 40, 2):
        k = rng.randrange(60)
        at = rng.randrange(len(docs[i][1]))
        docs[i] = (i, docs[i][1][:at] + " " + items[k][1].upper() + " " + docs[i][1][at:])
        want.add((i, k))
    docs += [(100, None), (101, ""), (102, items[0][1][: len(items[0][1]) // 2])]
    b = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    few = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b, index_bytes=1500)
    assert [(*k, *(round(x, 9) for x in v)) for *k, v in sorted((r.doc_id, r.item_id, tuple(r)[3:]) for r in few.collect())] == [(*k, *(round(x, 9) for x in v)) for *k, v in sorted((r.doc_id, r.item_id, tuple(r)[3:]) for r in got.collect())]
    assert decontamination.contaminated(nasty(spark), b).count() == 0
    page = next(r for r in nasty_rows() if r[1] and "\n" in r[1] and len(r[1]) > 300)[1]
    own = spark.createDataFrame([(1, page), (2, page), (None, page.split("\n")[0] + ". " + page.split("\n")[1])], "item_id long, text string")
    hits = collections.Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(nasty(spark), own).collect())
    assert hits == collections.Counter((r[0], i) for r in nasty_rows() if page in (r[1] or "") for i in (1, 2, None))
    assert decontamination.contaminated(nasty(spark), b.where("false")).count() == 0
    assert decontamination.contaminated(empty(spark), b).count() == 0


def test_wand_finds_all_above_the_threshold(monkeypatch):
    rng = random.Random(4)
    index = decontamination.Index([(i, words(rng, 12, "abc").encode()) for i in range(80)])
    found = 0
    for _ in range(60):
        terms = np.array(sorted({index.term[w] for w in words(rng, 30, "abc").encode().split() if w in index.term}))
        score = collections.Counter()
        for t in terms:
            for d, x in zip(*index.postings(t), strict=True):
                score[int(d)] += x
        want = {d for d, x in score.items() if x >= decontamination.THRESHOLD}
        assert {d for d, _ in index.walk(terms)} == want
        found += bool(want)
        for postings in (1 << 20, 50, 1):
            monkeypatch.setattr(decontamination, "POSTINGS", postings)
            got = index.promising(np.concatenate([terms] * 3), np.repeat([3, 5, 6], len(terms)))
            assert list(got) == ([3, 5, 6] if want else [])
            for blocks in got.values():
                assert {d for d, _ in index.walk(terms, blocks)} == want
    assert found


def test_items_are_judged_alike_whatever_others_there_are(spark):
    """One very long item changes neither the passages of short ones nor what they score; frequent words don't end the screen."""
    rng = random.Random(14)
    short = [(i, words(rng, 20, "abcdefghijkl") + ". " + words(rng, 8, "abcdefghijkl")) for i in range(20)]
    common = [(100 + i, "the of and. " + words(rng, 12, "abcdefghijkl")) for i in range(10)] + [(150, "the of. and")]
    long = (200, words(rng, 1500, "abcdefghijkl") + ". " + words(rng, 10, "abcdefghijkl"))
    docs = [(i, f"{words(rng, 300)} {t[1]} {words(rng, 200)}") for i, t in enumerate([*short, *common, long])] + [(99, words(rng, 400))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    found = lambda items: {(r.doc_id, r.item_id) for r in decontamination.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).collect()}
    few, all_ = found(short), found([*short, *common, long])
    assert {(i, i) for i in range(20)} <= few == {x for x in all_ if x[1] < 20}
    assert (30 + 1, 200) in all_ and {(20 + i, 100 + i) for i in range(10)} <= all_
    assert [decontamination.half_passage(n) for n in (1, 64, 65, 128, 1510)] == [64, 64, 128, 128, 2048]


# quality classifier


def test_classifier_held_out(spark):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        t = words(rng, 40)
        docs.append((i, "!! ".join(t.upper().split()) if bad and i % 8 else t + " vileword " + t if bad else t, "en", f"src{i % 5}"))
        if i % 3:
            labels.append((i, int(not (bad and i % 8)), int(bad and not i % 8)))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    out = classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    held = [r for r in out.collect() if r.doc_id % 3 == 0]
    assert sum(r.keep == (r.doc_id % 4 != 0) for r in held) >= 0.97 * len(held)


def site_shares(rows):
    """site_prior by (host, path), and the corpus's share, straight from documents' evidence."""
    p = [(r.host, r.path, 1 / (1 + math.exp(-r.evidence))) for r in rows]
    hosts, sites = collections.defaultdict(list), collections.defaultdict(list)
    for h, q, x in p:
        hosts[h].append(x)
        sites[h, q].append(x)
    n, mean = len(p), np.mean([x for *_, x in p])

    def worth(outer, inner, centre, base):
        k = len(inner) - len(outer)
        if k < 1:
            return 50.0
        within = sum(np.var(x) * len(x) for x in inner.values()) / max(1, n - len(inner))
        between = sum(len(x) * (np.mean(x) - centre(key)) ** 2 for key, x in inner.items()) / k
        size = (n - sum(len(x) ** 2 / base(key) for key, x in inner.items())) / k
        spread = (between - within) / size if size > 0 else None
        return 50.0 if spread is None else 1e6 if spread * 1e6 <= within else max(1.0, within / spread)

    of_host = worth({0: p}, hosts, lambda _: mean, lambda _: n)
    of_path = worth(hosts, sites, lambda k: np.mean(hosts[k[0]]), lambda k: len(hosts[k[0]]))
    overall = (sum(x for *_, x in p) + 1) / (n + 2)
    host = {h: (sum(x) + of_host * overall) / (len(x) + of_host) for h, x in hosts.items()}
    return {k: (sum(x) + of_path * host[k[0]]) / (len(x) + of_path) for k, x in sites.items()}, overall


def test_classifier_shrinks_sparse_sites(spark):
    rng = random.Random(15)
    docs, labels = [], []
    for i in range(500):
        host = i % 7 if i < 480 else f"s{i}"
        bad = i % 7 == 0 and i % 5 != 0 or i % 11 == 0
        docs.append((i, " ".join(["vile"] * rng.randrange(1, 4)) + " " + words(rng, 12) if bad else words(rng, 15), "en" if i % 3 else "de", str(host)))
        labels.append((i, int(not bad), 0))
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    rows = classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    prior, overall = site_shares(rows)
    logit = lambda x: math.log(x / (1 - x))
    for r in rows:
        assert math.isclose(r.site_prior, prior[r.host, r.path], rel_tol=1e-9)
        assert math.isclose(r.posterior, 1 / (1 + math.exp(-(r.evidence + logit(r.site_prior) - logit(overall)))), rel_tol=1e-9)
        assert r.keep == (r.posterior >= 0.5)
    own = {k: np.mean([1 / (1 + math.exp(-r.evidence)) for r in rows if (r.host, r.path) == k]) for k in prior}
    moved = {k: abs(prior[k] - overall) / abs(own[k] - overall) for k in prior if abs(own[k] - overall) > 0.02}
    assert max(v for k, v in moved.items() if k[0][0] == "s") < 1 and min(v for k, v in moved.items() if k[0] == "0") > max(v for k, v in moved.items() if k[0][0] == "s")


def test_classifier_nasty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    d = spark.createDataFrame([(i, "x", "en", "big" if i < 500 else f"s{i}") for i in range(510)], "doc_id long, text string, lang string, source string")
    assert {(r.keep, r.evidence, round(r.posterior, 9)) for r in classify(d, none).collect()} == {(True, 0.0, 0.5)}
    one = classify(nasty(spark), spark.createDataFrame([(1, None, None), (3, 1, None)], "doc_id long, quality int, toxic int")).collect()
    assert len(one) == len(nasty_rows()) and {r.evidence for r in one} == {4.0}
    both = classify(nasty(spark), spark.createDataFrame([(7, 0, 0), (5, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(both) == len(nasty_rows()) and site_shares(both)[0] == pytest.approx({(r.host, r.path): r.site_prior for r in both})
    assert classify(empty(spark), none).count() == 0


# line dedup


def test_line_dedup(spark):
    rng = random.Random(7)
    lines = [words(rng, 3) for _ in range(9)] + ["", "  "]
    docs = [(i // 2 * 2 + i % 2, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(40)]
    seen, want = set(), {}
    for i, t in docs:
        ls = t.split("\n")
        full = [k for k, x in enumerate(ls) if WORD.search(x)]
        gone = set()
        for j in range(len(full) - 2):
            key = tuple(ls[k] for k in full[j : j + 3])
            if key in seen:
                gone |= set(full[j : j + 3])
            seen.add(key)
        want[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(gone))
    got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: (r.text, r._n_removed) for r in got.collect()} == want


def test_line_dedup_nasty(spark):
    got = dedup_lines(nasty(spark))
    assert got.count() == len(nasty_rows()) and got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    by = {(r.doc_id, r.source): r for r in got.collect()}
    assert by[(0, None)].text is None and by[(10, "src1")]._n_removed == 8 and by[(9, "src0")]._n_removed == 0
    assert dedup_lines(empty(spark)).count() == 0


# SimHash


def brute_print(t):
    w = WORD.findall((t or "").translate(LOWER))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_nasty(spark):
    docs = [(r[0], brute_print(r[1])) for r in nasty_rows()]
    top = list(range(len(docs)))
    for _ in docs:
        top = [min(top[j] for j, (_, g) in enumerate(docs) if (f ^ g).bit_count() <= 2) for _, f in docs]
    group = collections.defaultdict(list)
    for k, (i, _) in zip(top, docs, strict=True):
        group[k].append(i)
    want = sorted(((i, f"{f:016x}", min((x for x in group[k] if x is not None), default=None)) for k, (i, f) in zip(top, docs, strict=True)), key=repr)
    assert rows_of(simhash.near_duplicates(nasty(spark)), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_are_complete(spark, monkeypatch):
    from perfloom.llm.common import components

    monkeypatch.setattr(simhash, "BUCKET", 6)
    rng = random.Random(8)
    codes = {rng.getrandbits(64) for _ in range(60)}
    for c in list(codes)[:12]:  # chains and balls
        for _ in range(40):
            c ^= 1 << rng.randrange(64)
            codes.add(c)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    root = {c: c for c in signed}
    changed = True
    while changed:
        changed = False
        for a in signed:
            for b in signed:
                if ((a ^ b) & (2**64 - 1)).bit_count() <= 2 and root[b] < root[a]:
                    root[a], changed = root[b], True
    df = spark.createDataFrame([(c,) for c in signed], "fp long")
    got = {r.node: r.root for r in components(simhash.links(df, len(signed))).collect()}
    assert {c: got.get(c, c) for c in signed} == root


# suffix dedup


def brute_repeats(docs):
    seen, out = set(), {}
    for i, t in docs:
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                cover[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        spans = sum(1 for k in range(len(b)) if cover[k] and (k == 0 or not cover[k - 1]))
        out[i] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeats(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df).collect()}


@pytest.mark.parametrize(("group", "held"), [(2000, 120_000), (3, 120_000), (3, 7)])
def test_suffix_dedup(spark, monkeypatch, group, held):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "HELD", held)
    monkeypatch.setattr(suffix_dedup, "PART", 500)
    rng = random.Random(9)
    parts = [words(rng, 40) for _ in range(4)]
    docs = [(i, "".join(rng.choice([rng.choice(parts)[rng.randrange(40) :], "a" * rng.randrange(250), "xyü" * rng.randrange(60), words(rng, rng.randrange(20))]) for _ in range(rng.randrange(7)))) for i in range(50)]
    assert repeats(spark.createDataFrame(docs, "doc_id long, text string")) == brute_repeats(docs)


def test_suffix_dedup_nasty(spark):
    rows = {(r[0], r[1]) for r in nasty_rows()}
    key = lambda x: (-1 if x[0] is None else x[0], xxhash.xxh64_intdigest((x[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((x[1] or "").encode(), 42) >> 63))
    want = {k: v for k, v in brute_repeats([((i, t), t) for i, t in sorted(rows, key=key)]).items()}
    got = rows_of(suffix_dedup.remove_repeats(nasty(spark)), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert got == sorted(((r[0], *want[r[0], r[1]][:3]) for r in nasty_rows()), key=repr)
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_deep_shallow_sort():
    rng = random.Random(10)
    for shallow in (8, 16, 40):
        arms = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(60))) for _ in range(80)]
        arms += [arms[0] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(60)] + arms[:30]
        groups, lcp = suffix_dedup.deep_shallow_sort(arms, shallow)
        assert [arms[g[0]] for g in groups] == sorted(set(arms))
        assert all({arms[i] for i in g} == {arms[g[0]]} for g in groups) and sorted(sum(groups, [])) == list(range(len(arms)))
        order = sorted(set(arms))
        assert lcp == [-1, *(len(os.path.commonprefix([a, b])) for a, b in zip(order, order[1:], strict=False))]


# quality rules


def test_quality_rules(spark):
    def brute(t):
        w = WORD.findall(t or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = collections.Counter(grams)
        rep = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep)

    want = sorted(((r[0], *(b := brute(r[1])), b[0] < 10 or 100 * b[4] > 20 * b[0]) for r in nasty_rows()), key=repr)
    assert rows_of(quality_rules.quality_rules(nasty(spark)), "doc_id", *quality_rules.STATS, "base_failed") == want
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_quality_rules_reject_depleted(spark):
    rng = random.Random(11)
    menu = words(rng, 20)
    docs = [(i, (menu.upper() if i % 2 else menu) + "\n" + (words(rng, 40) if i % 3 else f"a b c{i}"), "h" if i < 90 else "other") for i in range(100)]
    docs += [(100 + i, docs[0][1], "copies") for i in range(50)]  # one text, however often
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    judged = quality_rules.quality_rules(d, max_docs=11, min_docs=11)
    got = {r.doc_id: r.kept for r in judged.collect()}
    assert got == {i: not (i < 90 and i % 3 == 0) for i in range(150)}
    left = {r.doc_id: r.text for r in quality_rules.stripped(d, judged).collect()}
    assert left == {i: t.split("\n", 1)[1] if i < 90 else t for i, t, _ in docs if got[i]}
    loose = {r.doc_id: r.n_removed_words for r in quality_rules.quality_rules(d, max_docs=200, min_docs=200).collect()}
    assert set(loose.values()) == {0}


def test_quality_rules_limit_does_not_grow_with_the_host(spark):
    rng = random.Random(14)
    docs = [(i, ("shared line of words\n" if i < 10 else "") + words(rng, 12), "h") for i in range(1500)]
    got = {r.doc_id: r.n_removed_words for r in quality_rules.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    assert got == {i: 4 if i < 10 else 0 for i in range(1500)}


def test_anchors_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(13)
    bodies = [words(rng, n).encode() for n in (300, 3, 40, 2000, 1)] + [b"a" * 950]

    def starts(find):
        return {(int(i), s): (int(x), int(d + lo - s)) for p in find for i, x, lo, hi, d in zip(*p, strict=True) for s in range(int(lo), int(hi) + 1)}

    whole = starts(suffix_dedup.Anchors().find(bodies))
    assert len(whole) == sum(max(0, len(b) - 99) for b in bodies)
    monkeypatch.setattr(suffix_dedup, "PART", 200)
    assert starts(suffix_dedup.Anchors().find(bodies)) == whole
