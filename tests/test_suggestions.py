import random

from pyspark.sql import functions as F

from perfloom.functions import metrics as M
from perfloom.functions import text as T
from perfloom.operators import suggestions

SCHEMA = "seq long, title string, description string, pseudocode string, priority int, risk_level string, expected_gain string, n_steps int, source_model string, self_confidence double, base_weight double, final_weight double"


def row(seq, title, model="m", description="", gain="", weight=1.0, risk="low", priority=3, code="x", conf=0.9, base=1.0):
    return (seq, title, description, code, priority, risk, gain, 1, model, conf, base, weight)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalars(spark):
    assert [value(spark, M.risk_factor(F.lit(r))) for r in ("low", "medium", "high")] == [1.1, 1.0, 0.8]
    assert [value(spark, M.consensus_factor(F.lit(n))) for n in (0, 1, 2, 3, 4, 5)] == [0.8, 0.9, 1.0, 1.2, 1.2, 1.5]
    assert value(spark, M.gap_to_target(F.lit(300.0), F.lit(400.0))) == 25.0 and value(spark, M.gap_to_target(F.lit(1.0), F.lit(0.0))) == 0.0
    assert value(spark, M.priority_or_default(F.lit(9))) == 3 and value(spark, M.priority_clamped(F.lit(9))) == 5
    assert value(spark, M.default_weight(F.lit("GPT-4o"))) == 1.2 and value(spark, M.default_weight(F.lit("other"))) == 0.7


def test_jaccard(spark):
    j = lambda a, b, f=T.split_tokens: value(spark, T.jaccard(f(F.lit(a), T.CONSENSUS_TITLE), f(F.lit(b), T.CONSENSUS_TITLE)))
    assert j("skip list RCU optimization", "skip list RCU optimization") == 1.0
    assert j("RCU", "network zero copy") == 0.0 and j("the a", "the") == 0.0
    assert value(spark, T.word_tokens(F.lit("优化 rpc_并行 Café"))) == ["优化", "rpc_并行", "café"]


def test_weight_example(spark):
    s = frame(spark, [row(0, "a title of its own")]).drop("final_weight")
    h = spark.createDataFrame([], "source_model string, total long, adopted long")
    assert abs(suggestions.weighted(s, h).first().final_weight - 0.792) < 1e-12
    big = frame(spark, [row(0, "x", base=10.0)]).drop("final_weight")
    assert suggestions.weighted(big, h).first().final_weight == 2.0


def composite(a, b):
    j = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
    return 0.5 * j(a["tt"], b["tt"]) + 0.3 * j(a["dt"], b["dt"]) + 0.2 * j(a["gt"], b["gt"])


def greedy(rows):
    word = lambda t, stop: set(__import__("re").findall(r"\w+", (t or "").lower())) - set(stop)
    sets = {r[0]: {"tt": word(r[1], T.DEDUP_TITLE), "dt": word(r[2], T.DEDUP_KEYWORDS), "gt": word(r[6], T.DEDUP_KEYWORDS)} for r in rows}
    stay = []
    for r in rows:
        r = list(r)
        for k in stay:
            if composite(sets[r[0]], sets[k[0]]) > 0.75:
                if r[11] > k[11]:
                    stay.remove(k)
                    stay.append(r)
                elif r[8] not in k[8]:
                    k[8] += " + " + r[8]
                break
        else:
            stay.append(r)
    return sorted((r[0], r[8]) for r in stay)


def test_greedy_dedup_equals_the_loop(spark):
    rng = random.Random(3)
    w = "memory pool lock skip list batch raft".split()
    pick = lambda n: " ".join(rng.sample(w, n))
    rows = [row(i, pick(rng.randrange(1, 4)), f"m{rng.randrange(5)}", pick(rng.randrange(1, 4)), rng.choice(["20%", "10%"]), rng.randrange(20) / 10) for i in range(70)]
    got = sorted((r.seq, r.source_model) for r in suggestions.greedy_dedup(frame(spark, rows)).collect())
    assert got == greedy(rows)


def test_greedy_dedup_of_long_chains_and_many_equal_rows(spark):
    """Each row of the chain is alike its neighbours only; equal rows are one node."""
    rng = random.Random(9)
    chain = [row(i, " ".join(f"w{j}" for j in range(i, i + 10)), f"m{i % 3}", "same text", "5%", rng.randrange(9) / 4) for i in range(300)]
    equal = [row(1000 + i, "one title", f"m{i % 7}", "one text", "1%", rng.randrange(30) / 10) for i in range(500)]
    empty = [row(2000 + i, t, "m", d, "1%", 1.0) for i, (t, d) in enumerate([("", "x"), ("", "x"), ("a", ""), ("a", ""), ("a", "b"), ("a", "b")])]
    rows = chain + equal + empty
    got = sorted((r.seq, r.source_model) for r in suggestions.greedy_dedup(frame(spark, rows)).collect())
    assert got == greedy(rows) and 50 < len(got) < 290


def test_greedy_dedup_of_one_title_compares_few_sets(spark, monkeypatch):
    """Many texts under one title meet as sketches, in parts; as sets only those that may be alike. Nothing is lost."""
    rng = random.Random(14)
    w = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.sample(w, rng.choice([0, 5, 60, 900]))) for _ in range(150)]
    rows = [row(i, "one title of many", f"m{i % 4}", t, rng.choice(["QPS +1%", "QPS +2%", "x y z", ""]), rng.randrange(20) / 10) for i, t in enumerate(texts)]
    rows += [row(200 + i, rng.choice(["one title of many", "one title of some"]), f"m{i % 4}", " ".join(texts[i].split()[i % 9 :]), "QPS +1%", rng.randrange(20) / 10) for i in range(60)]
    tried, put = [], suggestions.slimmed
    monkeypatch.setattr(suggestions, "PART", 50)
    monkeypatch.setattr(suggestions, "MOST_TRIED", 1)
    monkeypatch.setattr(suggestions, "slimmed", lambda df, what, *rest: tried.append((what, put(df, what, *rest))) or tried[-1][1])
    got = sorted((r.seq, r.source_model) for r in suggestions.greedy_dedup(frame(spark, rows)).collect())
    assert got == greedy(rows) and len(got) < 205
    assert 0 < dict(tried)["dedup-candidates"].count() < 210 * 209 / 2 / 4
    assert [what for what, _ in tried].count("dedup-edges") > 1  # several passes


def test_greedy_dedup_of_one_title_makes_no_pairs(spark, monkeypatch):
    """Suggestions of one title are a group that is run as it is: no pair of them is a row. Shelves grow and lose who goes."""
    rng = random.Random(20)
    texts = [" ".join(rng.sample([f"w{i}" for i in range(90)], 40)) for _ in range(60)]
    rows = [row(i, "one title of many", f"m{i % 4}", rng.choice(texts), f"QPS +{i % 3}%", rng.randrange(20) / 10) for i in range(250)]
    rows += [row(300 + i, f"a title of {i}", "m", texts[i]) for i in range(5)]
    pairs, put = [], suggestions.slimmed
    monkeypatch.setattr(suggestions, "slimmed", lambda df, what, *rest: pairs.append((what, put(df, what, *rest))) or pairs[-1][1])
    s = frame(spark, rows)
    got = sorted((r.seq, r.source_model) for r in suggestions.greedy_dedup(s.drop("description"), texts=s).collect())
    assert got == greedy(rows) and 5 < len(got) < 250
    assert dict(pairs)["dedup-candidates"].count() == 0


def test_identical_twins_keep_the_heavier(spark):
    rows = [row(0, "内存优化", "deepseek", "使用内存池", "20%", 0.9), row(1, "内存优化", "claude", "使用内存池", "20%", 1.1)]
    got = suggestions.greedy_dedup(frame(spark, rows)).collect()
    assert len(got) == 1 and got[0].source_model.startswith("claude")


def by_set(sets):
    """Least seq and number of rows of each distinct set."""
    out = {}
    for i, x in sets:
        first, n = out.get(frozenset(x), (i, 0))
        out[frozenset(x)] = (min(first, i), n + 1)
    return out


def brute_pairs(sets, value, ok):
    kinds = by_set(sets)
    out = set()
    for a, (i, n) in kinds.items():
        for b, (j, m) in kinds.items():
            if (i < j or i == j and n > 1) and ok(value(a, b)):
                out.add((i, j, value(a, b), n, m))
    return out


def test_similar_pairs_lose_nothing(spark):
    rng = random.Random(4)
    sets = [(i, rng.sample("abcdefghij", rng.randrange(0, 7))) for i in range(60)]
    sets += [(100 + i, sets[5][1][::-1] or ["a"]) for i in range(9)]
    df = spark.createDataFrame(sets, "seq long, t array<string>")
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 0.0
    for least in (0.5, 0.6, 0.8):
        assert {tuple(r) for r in suggestions.similar_pairs(df, "t", least).collect()} == brute_pairs(sets, jaccard, lambda x, least=least: x > least)


def test_similarity_join_of_long_sets_makes_few_candidates(spark):
    """Copies with some tokens changed among sets of common words: no pair is lost, and what meets is near what is similar."""
    from perfloom.operators import set_similarity

    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(1500)]
    weights = [1 / (i + 20) for i in range(1500)]
    sets = []
    for _ in range(120):
        base = set(rng.choices(vocabulary, weights, k=rng.randrange(3, 400)))
        sets.append(base)
        for _ in range(rng.randrange(4)):
            gone = set(rng.sample(sorted(base), int(len(base) * rng.random() * 0.4)))
            sets.append((base - gone) | {f"x{rng.randrange(10**6)}" for _ in range(int(len(gone) * rng.random()))} or base)
    rows = [(i, sorted(x)) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "seq long, t array<string>")
    jaccard = lambda a, b: len(a & b) / len(a | b)
    for over in (0.5, 0.6, 0.8):
        want = brute_pairs(rows, jaccard, lambda x, over=over: x > over)
        assert {tuple(r) for r in suggestions.similar_pairs(df, "t", over).collect()} == want
        kinds = suggestions.kinds_of(df.select("seq", set_similarity.hashed(F.col("t")).alias("x")), "x")
        assert set_similarity.candidate_pairs(kinds, over).count() <= 10 * len(want) + len(sets)


def test_similarity_join_in_passes_blocks_and_of_hot_tokens_loses_nothing(spark, monkeypatch):
    """Long sets in several blocks, tokens in passes, hot tokens in Spark's join: the same pairs as brute force, and few candidates."""
    from perfloom.operators import set_similarity

    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(2500)]
    weights = [1 / (i + 20) for i in range(2500)]
    sets = []
    for _ in range(60):
        base = set(rng.choices(vocabulary, weights, k=rng.randrange(3, 900)))
        sets.append(base)
        for _ in range(rng.randrange(4)):
            gone = set(rng.sample(sorted(base), int(len(base) * rng.random() * 0.4)))
            sets.append((base - gone) | {f"x{rng.randrange(10**6)}" for _ in range(int(len(gone) * rng.random()))} or base)
    rows = [(i, sorted(x)) for i, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "seq long, t array<string>")
    for name, value in {"LONG": 60, "BLOCK": 20, "MOST_IN_BLOCK": 20, "MANY": 0, "HOT_SETS": 8, "AT_ONCE": 50}.items():
        monkeypatch.setattr(set_similarity, name, value)
    want = brute_pairs(rows, lambda a, b: len(a & b) / len(a | b), lambda x: x > 0.6)
    assert {tuple(r) for r in suggestions.similar_pairs(df, "t", 0.6).collect()} == want
    kinds = suggestions.kinds_of(df.select("seq", set_similarity.hashed(F.col("t")).alias("x")), "x")
    assert set_similarity.candidate_pairs(kinds, 0.6).count() <= 2 * len(want)


def test_related_code_takes_the_first_file_of_any_term(spark):
    files = [("b/raft.cc", "x\nthe LOG\nBatch of raft\nend"), ("a/none.cc", "nothing"), ("c/apply.cc", "apply\nraft\nlog"), ("a/rpc.cc", "1\n2\n3\nRpc call\n5\n6\n7\n8\n9\n10")]
    rows = [row(0, "raft apply"), row(1, "apply"), row(2, "rpc and raft"), row(3, "zzz"), row(4, "batch", description="log")]
    got = {r.seq: (r.path, r.pos, r.code) for r in suggestions.related_code(frame(spark, rows), spark.createDataFrame(files, "path string, content string")).collect()}
    assert got == {0: ("b/raft.cc", 2, files[0][1]), 1: ("c/apply.cc", 0, files[2][1]), 2: ("a/rpc.cc", 3, "2\n3\nRpc call\n5\n6\n7\n8"), 4: ("b/raft.cc", 2, files[0][1])}


def test_conflicts(spark):
    rng = random.Random(5)
    titles = [(i, " ".join(rng.sample("ab cd ef gh ij kl mn op qr".split(), rng.randrange(1, 5)))) for i in range(50)] + [(60, "AB cd"), (61, "cd ab")]
    got = {tuple(r) for r in suggestions.conflicts(spark.createDataFrame(titles, "seq long, title string")).collect()}
    assert got == brute_pairs([(i, t.lower().split()) for i, t in titles], lambda a, b: len(a & b), lambda x: x >= 2)


def test_conflicts_meet_by_number(spark, monkeypatch):
    """What is shuffled for each pair is two numbers, not two keys of 33 characters or more."""
    seen = []
    monkeypatch.setattr(suggestions, "named_pairs", lambda pairs, *rest: seen.append(dict(pairs.dtypes)) or pairs)
    suggestions.conflicts(spark.createDataFrame([(1, "a b"), (2, "a b c")], "seq long, title string"))
    assert (seen[0]["a"], seen[0]["b"]) == ("bigint", "bigint")


def test_consensus_counts(spark):
    rng = random.Random(6)
    w = "memory pool lock skip list batch raft window".split()
    rows = [row(i, " ".join(rng.sample(w, rng.randrange(0, 4))), rng.choice(["a", "b", "c"]), " ".join(rng.sample(w, rng.randrange(0, 7)))) for i in range(60)]
    rows += [row(100 + i, "the same", rng.choice(["a", "b"]), "twins all over") for i in range(30)]
    word = lambda t, stop: set(__import__("re").findall(r"\w+", t.lower())) - set(stop)
    j = lambda a, b: len(a & b) / len(a | b) if a and b else 0.0
    sets = [(r[8], set(r[1].lower().split()) - set(T.CONSENSUS_TITLE), word(r[2], T.CONSENSUS_KEYWORDS)) for r in rows]
    want = {r[0]: sum(m != x[0] and (j(t, x[1]) > 0.8 or j(d, x[2]) > 0.6) for m, t, d in sets) for r, x in zip(rows, sets, strict=True)}
    assert {r.seq: r.n_similar for r in suggestions.consensus_counts(frame(spark, rows)).collect()} == want


def test_consensus_shuffles_numbers_and_only_sets_that_meet(spark, monkeypatch):
    """Edges are pairs of numbers; sets of a large input are dealt over two shuffles; of 200 sets without a like one hardly any is verified."""
    from perfloom.operators import set_similarity

    word = lambda i: " ".join(f"w{i}x{j}" for j in range(6)) + " common words"
    rows = [row(i, f"title {i}", f"m{i % 3}", word(i)) for i in range(200)] + [row(300 + i, f"other {i}", f"m{i}", word(7) + " more" * i) for i in range(2)]
    edges, verified, take = [], spark.sparkContext.accumulator(0), set_similarity.marked
    put = suggestions.staged

    def marked(bitmap, h):
        at = take(bitmap, h)
        verified.add(len(at))
        return at

    monkeypatch.setattr(set_similarity, "marked", marked)
    monkeypatch.setattr(suggestions, "MANY", 0)
    monkeypatch.setattr(suggestions, "staged", lambda df, what, *rest: edges.extend(t for _, t in df.dtypes if what.endswith("-edges")) or put(df, what, *rest))
    got = {r.seq: r.n_similar for r in suggestions.consensus_counts(frame(spark, rows)).collect()}
    assert got == {i: 0 for i in range(200)} | {7: 1, 300: 2, 301: 1}  # those of models 1, 0 and 1
    assert set(edges) == {"bigint"} and 0 < verified.value < 40


def test_kinds_in_passes_are_the_same(spark):
    df = spark.createDataFrame([(i, sorted({i % 37, i % 5})) for i in range(400)], "seq long, x array<long>")
    once, twice = (suggestions.kinds_of(df, "x", passes).collect() for passes in (1, 2))
    told = lambda rows: sorted((r.k, r.x, r.n, r["first"]) for r in rows)
    assert told(once) == told(twice) and len({r.no for r in twice}) == len(twice)


def test_hashed_words_are_the_hashed_tokens(spark):
    from perfloom.operators.set_similarity import hashed, hashed_words

    texts = [None, "", " ", "the the", "The lock, a LOCK_2 (é优化)", "…x…", "is this it", "\na\tb "]
    s = spark.createDataFrame([(t,) for t in texts], "t string")
    both = s.select(hashed(T.word_tokens(F.col("t"), T.DEDUP_KEYWORDS)), hashed_words(F.col("t"), T.DEDUP_KEYWORDS)).collect()
    assert all(a == b for a, b in both) and sorted(len(a) for a, _ in both) == [0, 0, 0, 0, 0, 1, 1, 3]


def test_aggregate_ranks_thin_rows(spark):
    """The rows are those of the plain way; what is sorted for the ranking holds no text."""
    rng = random.Random(4)
    s = frame(spark, [row(i, f"title {i % 9} of", f"m{i % 4}", f"text {i % 5} with words", f"{i % 3}%", risk=rng.choice(["low", "high"]), base=rng.randrange(1, 9) / 4, code="" if i % 4 == 0 else "x") for i in range(60)]).drop("final_weight")
    none = spark.createDataFrame([], "source_model string, total long, adopted long")
    plain = suggestions.top_ranked(suggestions.quality_filter(suggestions.greedy_dedup(suggestions.weighted(s, none))))
    got = suggestions.aggregate(s, none)
    assert got.columns == plain.columns and got.collect() == plain.orderBy("rank").collect() and got.count() == 5
    held = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in line or "GlobalLimit" in line]
    assert held and "description" not in " ".join(x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "TakeOrderedAndProject" in x)


def test_filter_rank_verify(spark):
    d = {"description": "d"}
    rows = [row(0, "a", weight=0.29, **d), row(1, "b", code="# 无代码", **d), row(2, "c", risk="high", weight=2.0, **d), row(3, "d", risk="low", weight=0.5, **d), row(4, "", code="")]
    s = frame(spark, rows)
    assert [r.seq for r in suggestions.top_ranked(suggestions.quality_filter(s)).orderBy("rank").collect()] == [3, 2]
    v = {r.seq: r for r in suggestions.verified(s).collect()}
    assert v[3].passed == 6 and v[3].is_valid and v[4].passed == 3 and not v[4].is_valid
    assert {r.seq for r in suggestions.prefix_dedup(frame(spark, [row(0, "T" * 40, priority=1), row(1, "t" * 35, priority=4), row(2, "t" * 50, priority=4)])).collect()} == {1}


def test_scratch_removes_what_is_not_kept(spark):
    from perfloom.operators import scale

    def there(df):
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)

    with scale.scratch(spark) as outer:
        with scale.scratch(spark) as keep:
            a, b, c = (scale.staged(spark.range(3), x) for x in "abc")
            keep(a)
            keep(b)
        assert there(a) and there(b) and not there(c)
        outer(a)
    assert there(a) and not there(b) and a.count() == 3


def test_components(spark):
    from perfloom.operators.scale import components

    edges = [(5, 3), (3, 9), (7, 8), (2, 2), (10, 11), (11, 12), (12, 13), (13, 1)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 7: 7, 8: 7, 1: 1, 10: 1, 11: 1, 12: 1, 13: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
