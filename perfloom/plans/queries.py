"""Named queries over the generated tables, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as M
from ..functions import text as T
from ..operators import caches, diagnosis, history, parsers, reports, responses, suggestions, summaries
from ..sources import sinks
from ..sources import tables as S
from ..streaming import observe

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


SNAP = """snap AS (
 SELECT ts, n::DOUBLE / 86400e0 AS qps, s::DOUBLE / n::DOUBLE AS avg_latency, p50_latency, p99_latency, e::DOUBLE / n::DOUBLE AS error_rate, 4e-3 AS target_qps
 FROM (SELECT ts, count(*) AS n, sum(value::DECIMAL(20,6)) AS s, count(*) FILTER (WHERE event_type = 'error') AS e,
        list_sort(list(value))[least(floor(count(*) * 0.5e0)::INT, count(*)::INT - 1) + 1] AS p50_latency,
        list_sort(list(value))[least(floor(count(*) * 0.99e0)::INT, count(*)::INT - 1) + 1] AS p99_latency
       FROM (SELECT date_trunc('day', ts)::TIMESTAMP AS ts, value, event_type FROM events) GROUP BY ts))"""
REC = """rec AS (
 SELECT o_orderkey AS seq, o_orderpriority AS system, o_orderdate AS ts, o_totalprice AS target_qps, actual_qps, avg_latency, error_rate, threads
 FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(20,4) * (1 - l_discount::DECIMAL(10,4)))::DOUBLE AS actual_qps, sum(l_quantity::DECIMAL(20,4))::DOUBLE / count(*) AS avg_latency,
   count(*) FILTER (WHERE l_returnflag = 'R') / count(*)::DOUBLE AS error_rate, count(*)::INT AS threads FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""
SUG = r"""sug AS (
 SELECT doc_id AS seq, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[1:4], ' ') AS title, text AS description,
  CASE WHEN doc_id % 7 = 0 THEN '# 无代码' ELSE 'lock(m) {' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '}' END END AS pseudocode,
  (1 + doc_id % 5)::INT AS priority, CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS risk_level,
  CASE WHEN doc_id % 6 = 0 THEN '' ELSE 'QPS +' || (doc_id % 40) || '%' END AS expected_gain, (doc_id % 4)::INT AS n_steps, source AS source_model, (doc_id % 11) / 10e0 AS self_confidence, 1e0 AS base_weight
 FROM documents)"""


def stop(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def split_sql(c: str, words: list[str]) -> str:
    return rf"list_filter(list_distinct(regexp_split_to_array(lower({c}), '\s+')), lambda w: w <> '' AND NOT list_contains({stop(words)}, w))"


def word_sql(c: str, words: list[str]) -> str:
    return rf"list_filter(list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')), lambda w: NOT list_contains({stop(words)}, w))"


def jac(a: str, b: str) -> str:
    n = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0e0 ELSE {n}::DOUBLE / (len({a}) + len({b}) - {n}) END"


def kinds_sql(name: str, sets: str, tokens: str, over: str) -> str:
    """CTEs: distinct token sets of a relation (numbered), and all ordered pairs of those that are similar, each with itself."""
    return f"""{name}k AS MATERIALIZED (SELECT row_number() OVER () AS k, x, len(x) AS n FROM (SELECT DISTINCT list_sort({tokens}) AS x FROM {sets})), {name}t AS MATERIALIZED (SELECT k, n, unnest(x) AS t FROM {name}k),
{name}p AS MATERIALIZED (SELECT x.k AS a, y.k AS b, count(*)::DOUBLE / (x.n + y.n - count(*)) AS similarity FROM {name}t x JOIN {name}t y ON x.t = y.t GROUP BY x.k, y.k, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) > {over})"""


def pairs_sql(sets: str, tokens: str, over: str) -> str:
    """similar_pairs of a relation with seq."""
    return f"""{kinds_sql("o", sets, tokens, over)}, f AS (SELECT k, min(seq) AS f, count(*) AS m FROM {sets} JOIN ok ON list_sort({tokens}) = ok.x GROUP BY k)
SELECT i.f AS a, j.f AS b, similarity, i.m AS n_a, j.m AS n_b FROM op JOIN f i ON op.a = i.k JOIN f j ON op.b = j.k WHERE i.f < j.f OR i.f = j.f AND i.m > 1"""


SETS = f"""sets AS MATERIALIZED (SELECT seq, source_model, {split_sql("title", T.CONSENSUS_TITLE)} AS tt, {word_sql("description", T.CONSENSUS_KEYWORDS)} AS dt FROM sug),
{kinds_sql("t", "sets", "tt", "0.8e0")}, {kinds_sql("d", "sets", "dt", "0.6e0")},
rk AS MATERIALIZED (SELECT seq, source_model AS m, tk.k AS t, dk.k AS d FROM sets JOIN tk ON list_sort(tt) = tk.x JOIN dk ON list_sort(dt) = dk.x),
pairs AS (SELECT x.seq AS a, y.seq AS b FROM rk x JOIN tp ON x.t = tp.a JOIN rk y ON y.t = tp.b WHERE x.m <> y.m UNION SELECT x.seq, y.seq FROM rk x JOIN dp ON x.d = dp.a JOIN rk y ON y.d = dp.b WHERE x.m <> y.m),
cons AS (SELECT sug.seq, count(p.a) AS n_similar FROM sug LEFT JOIN pairs p ON sug.seq = p.a GROUP BY sug.seq),
hist AS (SELECT source AS source_model, count(*) AS total, sum(quality)::BIGINT AS adopted FROM documents JOIN labels USING (doc_id) GROUP BY 1),
weights AS (SELECT sug.*, n_similar, greatest(0.1e0, least(2e0, base_weight * ((coalesce(adopted, 0) + 1e0) / (coalesce(total, 0) + 2e0) + 0.5e0)
   * CASE WHEN n_similar = 0 THEN 0.8e0 WHEN n_similar = 1 THEN 0.9e0 WHEN n_similar = 2 THEN 1e0 WHEN n_similar <= 4 THEN 1.2e0 ELSE 1.5e0 END
   * self_confidence * CASE risk_level WHEN 'low' THEN 1.1e0 WHEN 'medium' THEN 1e0 ELSE 0.8e0 END)) AS final_weight
  FROM sug JOIN cons USING (seq) LEFT JOIN hist USING (source_model))"""
LAG = """SELECT ts, qps, {c} AS qps_change, {l} AS latency_change, error_rate - pe AS error_rate_change,
 coalesce({c}, 0) < -5 OR coalesce(error_rate - pe, 0) > 0.01e0 AS has_regression,
 CASE WHEN coalesce({c}, 0) < -20 OR coalesce(error_rate - pe, 0) > 0.05e0 THEN 'severe' WHEN coalesce({c}, 0) < -10 OR coalesce(error_rate - pe, 0) > 0.02e0 THEN 'moderate'
  WHEN coalesce({c}, 0) < -5 OR coalesce(error_rate - pe, 0) > 0.01e0 THEN 'minor' ELSE 'none' END AS severity FROM p""".format(c="CASE WHEN pq > 0 THEN (qps - pq) / pq * 100 WHEN pq IS NOT NULL THEN 0 END", l="CASE WHEN pl > 0 THEN (avg_latency - pl) / pl * 100 WHEN pl IS NOT NULL THEN 0 END")


@query(f"WITH {SNAP} SELECT * FROM snap")
def q01_snapshots_daily(spark: SparkSession, sf: str) -> DataFrame:
    return S.snapshots(spark, sf)


@query(f"WITH {SNAP}, p AS (SELECT *, lag(qps) OVER w AS pq, lag(avg_latency) OVER w AS pl, lag(error_rate) OVER w AS pe FROM snap WINDOW w AS (ORDER BY ts)) {LAG}")
def q02_regression_compare(spark, sf):
    return history.compare_previous(S.snapshots(spark, sf)).select("ts", "qps", "qps_change", "latency_change", "error_rate_change", "has_regression", "severity")


@query(f"WITH {SNAP}, p AS (SELECT s.*, b.qps AS pq, b.avg_latency AS pl, b.error_rate AS pe FROM snap s, (SELECT * FROM snap ORDER BY ts LIMIT 1) b) {LAG}")
def q03_regression_vs_baseline(spark, sf):
    return history.compare_baseline(S.snapshots(spark, sf)).select("ts", "qps", "qps_change", "latency_change", "error_rate_change", "has_regression", "severity")


LONG = "one AS (UNPIVOT (SELECT ts, qps, avg_latency, p99_latency FROM snap WHERE ts >= (SELECT max(ts) FROM snap) - INTERVAL 7 DAY) ON qps, avg_latency, p99_latency INTO NAME metric VALUE v)"


@query(f"""WITH {SNAP}, {LONG}, a AS (SELECT metric, count(*) AS n, arg_min(v, ts) AS f, arg_max(v, ts) AS l FROM one GROUP BY metric), c AS (SELECT *, CASE WHEN f > 0 THEN (l - f) / f * 100 ELSE 0 END AS c FROM a)
SELECT metric, n, f AS previous, l AS current, c AS change_percent, CASE WHEN c > 5 THEN 'improving' WHEN c < -5 THEN 'degrading' ELSE 'stable' END AS trend FROM c""")
def q04_trend_first_last(spark, sf):
    return history.trend_first_last(S.snapshots(spark, sf), ["qps", "avg_latency", "p99_latency"])


@query(f"""WITH {SNAP}, {LONG}, r AS (SELECT metric, v::DECIMAL(30,12) AS v, row_number() OVER (PARTITION BY metric ORDER BY ts) AS r, count(*) OVER (PARTITION BY metric) AS n FROM one),
a AS (SELECT metric, max(n) AS n, (sum(v) FILTER (WHERE r <= n // 2))::DOUBLE / count(*) FILTER (WHERE r <= n // 2) AS a, (sum(v) FILTER (WHERE r > n // 2))::DOUBLE / count(*) FILTER (WHERE r > n // 2) AS b, min(v)::DOUBLE AS min_value, max(v)::DOUBLE AS max_value FROM r GROUP BY metric)
SELECT metric, n, CASE WHEN a > 0 THEN (b - a) / a * 100 ELSE 0 END AS change_percent, min_value, max_value, CASE WHEN b > a * 1.05e0 THEN 'increasing' WHEN b < a * 0.95e0 THEN 'decreasing' ELSE 'stable' END AS trend FROM a""")
def q05_trend_half_split(spark, sf):
    return history.trend_half_split(S.snapshots(spark, sf), ["qps", "avg_latency", "p99_latency"])


@query(f"WITH {SNAP} SELECT ts, qps FROM snap ORDER BY ts DESC LIMIT 5")
def q06_recent_topk(spark, sf):
    return summaries.latest(S.snapshots(spark, sf).select("ts", "qps"), 5)


@query(f"""WITH {REC} SELECT system, count(*) AS total, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE ok) / count(*)::DOUBLE AS success_rate, sum(actual_qps::DECIMAL(30,6))::DOUBLE / count(*) AS avg_qps,
 sum(avg_latency::DECIMAL(30,6))::DOUBLE / count(*) AS avg_latency, sum((avg_latency * 2)::DECIMAL(30,6))::DOUBLE / count(*) AS avg_p99, max(actual_qps) AS max_qps, arg_max(ts, seq) AS latest FROM (SELECT *, actual_qps >= target_qps * 0.9e0 AND error_rate < 0.05e0 AS ok FROM rec) GROUP BY system""")
def q07_record_summary(spark, sf):
    return history.record_summary(S.records(spark, sf).withColumn("p99_latency", F.col("avg_latency") * 2))


@query(f"WITH {REC} SELECT seq, system, actual_qps FROM rec ORDER BY actual_qps DESC, seq LIMIT 1")
def q08_best_record(spark, sf):
    return summaries.best(S.records(spark, sf).select("seq", "system", "actual_qps"), "actual_qps", "seq")


@query(f"WITH {SNAP} SELECT ts, qps FROM snap WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'")
def q09_timerange(spark, sf):
    return history.time_range(S.snapshots(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("ts", "qps")


#: Metrics that reach every branch of the rules, drawn from event ids.
MET = "met AS (SELECT event_id, (event_id % 8) * 60e0 AS qps, (event_id % 7) * 2e0 AS avg_latency, (event_id % 9) * 8e0 AS p99_latency, (event_id % 10) / 100e0 AS error_rate, (event_id % 5) * 100e0 AS target_qps FROM events)"


def _metrics(spark, sf):
    k = F.col("event_id")
    return S.table(spark, sf, "events").select("event_id", ((k % 8) * F.lit(60.0)).alias("qps"), ((k % 7) * F.lit(2.0)).alias("avg_latency"), ((k % 9) * F.lit(8.0)).alias("p99_latency"), ((k % 10) / F.lit(100.0)).alias("error_rate"), ((k % 5) * F.lit(100.0)).alias("target_qps"))


@query(f"""WITH {MET}, c AS (SELECT event_id, (CASE WHEN qps >= 300 THEN 30 WHEN qps >= 200 THEN 20 WHEN qps >= 100 THEN 10 ELSE 0 END) + (CASE WHEN avg_latency <= 5 THEN 25 WHEN avg_latency <= 10 THEN 15 ELSE 0 END)
 + (CASE WHEN p99_latency <= 20 THEN 25 WHEN p99_latency <= 50 THEN 15 ELSE 0 END) + (CASE WHEN error_rate < 0.01e0 THEN 20 WHEN error_rate < 0.05e0 THEN 10 ELSE 0 END) AS score, qps >= target_qps * 0.9e0 AS achievable FROM met)
SELECT event_id, score, CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade, achievable FROM c""")
def q10_metric_scorecard(spark, sf):
    s = M.score_card(F.col("qps"), F.col("avg_latency"), F.col("p99_latency"), F.col("error_rate"))
    return _metrics(spark, sf).select("event_id", s.alias("score"), M.grade(s).alias("grade"), M.achievable(F.col("qps"), F.col("target_qps")).alias("achievable"))


@query(f"""WITH {MET} SELECT event_id, CASE WHEN target_qps <= 0 THEN 0 ELSE (target_qps - qps) / target_qps * 100 END AS gap, error_rate < 0.01e0 AS healthy, qps >= target_qps * 0.9e0 AND error_rate < 0.05e0 AS success,
 greatest(2, least(16, trunc(qps * 10 / 90)::INT + 1)) AS threads FROM met""")
def q11_gap_health(spark, sf):
    q, t, e = F.col("qps"), F.col("target_qps"), F.col("error_rate")
    return _metrics(spark, sf).select("event_id", M.gap_to_target(q, t).alias("gap"), M.is_healthy(e).alias("healthy"), M.succeeded(q, t, e).alias("success"), M.threads_for(q * 10).alias("threads"))


@query("""SELECT o_orderpriority AS system, count(*) AS total, count(*) FILTER (WHERE l_linestatus = 'F') AS adopted, count(*) FILTER (WHERE l_linestatus = 'F') / count(*)::DOUBLE AS adoption_rate,
""" + ", ".join(f"count(*) FILTER (WHERE 1 + l_linenumber % 5 = {i}) AS priority_{i}" for i in range(1, 6)) + """, count(*) FILTER (WHERE l_returnflag NOT IN ('R', 'A')) AS risk_low, count(*) FILTER (WHERE l_returnflag = 'A') AS risk_medium,
 count(*) FILTER (WHERE l_returnflag = 'R') AS risk_high FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def q12_adoption_stats_nested(spark, sf):
    return history.adoption_stats(S.records(spark, sf))


@query("""SELECT source AS source_model, count(*) AS total, sum(quality)::BIGINT AS adopted, sum(quality)::DOUBLE / count(*) AS accuracy, (sum(quality)::BIGINT + 1e0) / (count(*) + 2e0) + 0.5e0 AS weight FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def q13_model_stats_bayes(spark, sf):
    h = S.model_history(spark, sf)
    return h.select("*", F.try_divide(F.col("adopted").cast("double"), F.col("total")).alias("accuracy"), M.accuracy_factor(F.col("adopted"), F.col("total")).alias("weight"))


@query(f"WITH {SUG}, s AS MATERIALIZED (SELECT seq, {word_sql('title', T.DEDUP_TITLE)} AS x FROM sug), {pairs_sql('s', 's.x', '0.5e0')}")
def q14_title_jaccard_pairs(spark, sf):
    s = S.suggestions(spark, sf).select("seq", T.word_tokens(F.col("title"), T.DEDUP_TITLE).alias("tt"))
    return suggestions.similar_pairs(s, "tt", 0.5)


@query(f"WITH {SUG}, s AS MATERIALIZED (SELECT seq, {word_sql('description', T.CONSENSUS_KEYWORDS)} AS x FROM sug), {pairs_sql('s', 's.x', '0.6e0')}")
def q15_keyword_jaccard_pairs(spark, sf):
    s = S.suggestions(spark, sf).select("seq", T.word_tokens(F.col("description"), T.CONSENSUS_KEYWORDS).alias("dt"))
    return suggestions.similar_pairs(s, "dt", 0.6)


@query(f"WITH {SUG}, {SETS} SELECT seq, n_similar FROM cons")
def q16_consensus_count(spark, sf):
    return suggestions.consensus_counts(S.suggestions(spark, sf))


@query(f"WITH {SUG}, {SETS} SELECT seq, source_model, n_similar, final_weight FROM weights")
def q17_final_weight(spark, sf):
    return suggestions.weighted(S.suggestions(spark, sf), S.model_history(spark, sf)).select("seq", "source_model", "n_similar", "final_weight")


def _prefix(n: int) -> str:
    return f"WITH {SUG}, r AS (SELECT *, row_number() OVER (PARTITION BY substring(lower(title), 1, {n}) ORDER BY priority DESC, seq) AS r FROM sug) SELECT seq, title, priority FROM r WHERE r = 1"


@query(_prefix(30))
def q18_prefix_dedup30(spark, sf):
    return suggestions.prefix_dedup(S.suggestions(spark, sf), 30).select("seq", "title", "priority")


@query(_prefix(20))
def q19_prefix_dedup20(spark, sf):
    return suggestions.prefix_dedup(S.suggestions(spark, sf), 20).select("seq", "title", "priority")


def _weighted(spark, sf):
    return suggestions.weighted(S.suggestions(spark, sf), S.model_history(spark, sf))


@query()
def q20_greedy_dedup(spark, sf):
    return suggestions.greedy_dedup(_weighted(spark, sf), texts=S.suggestions(spark, sf)).select("seq", "source_model", "final_weight")


GOOD = "final_weight >= 0.3e0 AND coalesce(title, '') <> '' AND coalesce(description, '') <> '' AND coalesce(pseudocode, '') NOT IN ('', '# 无代码')"


@query(f"""WITH {SUG}, {SETS} SELECT seq, title, risk_level, final_weight, row_number() OVER (ORDER BY CASE risk_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, final_weight DESC, priority DESC, seq)::INT AS rank
 FROM weights WHERE {GOOD} ORDER BY rank LIMIT 20""")
def q21_rank_filter_topk(spark, sf):
    return _ranked(spark, sf).select("seq", "title", "risk_level", "final_weight", "rank")


@query()
def q22_aggregate_end_to_end(spark, sf):
    return suggestions.aggregate(S.suggestions(spark, sf), S.model_history(spark, sf)).select("rank", "seq", "title", "source_model", "risk_level", "final_weight")


@query(f"WITH {SUG} SELECT r.pos, r.risk_level, count(seq) OVER g AS n, coalesce(max(priority) OVER g, 0)::INT AS top_priority, CASE WHEN seq IS NOT NULL THEN row_number() OVER (PARTITION BY risk_level ORDER BY seq) END AS rank, seq, title FROM (VALUES (0, 'low'), (1, 'medium'), (2, 'high')) r(pos, risk_level) LEFT JOIN sug USING (risk_level) WINDOW g AS (PARTITION BY risk_level)")
def q23_group_by_risk(spark, sf):
    return summaries.grouped_by_risk(S.suggestions(spark, sf))


@query(f"WITH {SUG} SELECT unnest(string_split(source_model || CASE WHEN seq % 9 = 0 THEN ' + extra' ELSE '' END, ' + ')) AS model, count(*) AS n FROM sug GROUP BY 1")
def q24_summary_by_model_split(spark, sf):
    s = S.suggestions(spark, sf).withColumn("source_model", F.concat("source_model", F.when(F.col("seq") % 9 == 0, " + extra").otherwise("")))
    return s.select(F.explode(F.split("source_model", r" \+ ")).alias("model")).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SUG}, s AS (SELECT list_sort({split_sql('title', ['!'])}) AS x, min(seq) AS f, count(*) AS m FROM sug GROUP BY 1 HAVING len(x) >= 2), t AS (SELECT f, m, unnest(x) AS t FROM s)
SELECT x.f AS a, y.f AS b, count(*) AS overlap, x.m AS n_a, y.m AS n_b FROM t x JOIN t y ON x.t = y.t AND (x.f < y.f OR x.f = y.f AND x.m > 1) GROUP BY ALL HAVING count(*) >= 2""")
def q25_conflict_pairs(spark, sf):
    return suggestions.conflicts(S.suggestions(spark, sf))


@query(rf"WITH {SUG}, s AS (SELECT array_to_string(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda w: w <> '')[1:2], ' ') AS topic FROM sug) SELECT topic, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 2")
def q26_topic_groups(spark, sf):
    return suggestions.topics(S.suggestions(spark, sf))


def _checked(spark, sf):
    """Suggestions of which some lack what the checks ask for."""
    k, n = F.col("seq"), S.suggestions(spark, sf)
    return n.withColumns({"description": F.when(k % 3 == 0, "").otherwise(F.col("description")), "pseudocode": F.when(k % 4 == 0, "").otherwise(F.col("pseudocode")), "risk_level": F.when(k % 8 == 0, "odd").otherwise(F.col("risk_level")), "priority": F.when(k % 9 == 0, 9).otherwise(F.col("priority")), "expected_gain": F.when(k % 5 == 0, "未知").otherwise(F.col("expected_gain"))})


CHECKS = f"""WITH {SUG}, chk AS (SELECT * REPLACE (CASE WHEN seq % 3 = 0 THEN '' ELSE description END AS description, CASE WHEN seq % 4 = 0 THEN '' ELSE pseudocode END AS pseudocode, CASE WHEN seq % 8 = 0 THEN 'odd' ELSE risk_level END AS risk_level, CASE WHEN seq % 9 = 0 THEN 9 ELSE priority END AS priority, CASE WHEN seq % 5 = 0 THEN '未知' ELSE expected_gain END AS expected_gain) FROM sug),
v AS (SELECT seq, risk_level, (coalesce(title, '') <> '')::INT + (coalesce(description, '') <> '')::INT + (coalesce(pseudocode, '') <> '')::INT + (priority BETWEEN 1 AND 5)::INT + (risk_level IN ('low', 'medium', 'high'))::INT
  + (coalesce(expected_gain, '') NOT IN ('', '未知'))::INT + (n_steps > 0)::INT AS passed FROM chk), w AS (SELECT *, passed / 7e0 AS confidence, passed >= 7e0 * 0.7e0 AS is_valid FROM v)"""


@query(f"{CHECKS} SELECT * FROM w")
def q27_verify_checks(spark, sf):
    return suggestions.verified(_checked(spark, sf))


@query(f"{CHECKS} SELECT seq, CASE risk_level WHEN 'low' THEN least(1e0, confidence + 0.1e0) WHEN 'high' THEN greatest(0e0, confidence - 0.1e0) ELSE confidence END AS confidence FROM w")
def q99_verify_by_risk(spark, sf):
    return suggestions.verified(_checked(spark, sf), strict_enum=True).select("seq", "confidence")


@query(f"{CHECKS} SELECT count(*) AS total, count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE is_valid AND risk_level = 'low') AS low, count(*) FILTER (WHERE is_valid AND risk_level = 'medium') AS medium, count(*) FILTER (WHERE is_valid AND risk_level = 'high') AS high, (sum(passed) FILTER (WHERE is_valid))::BIGINT AS checks_passed, (sum(confidence::DECIMAL(30,12)) FILTER (WHERE is_valid))::DOUBLE / count(*) FILTER (WHERE is_valid) AS avg_confidence, (SELECT title FROM w JOIN sug USING (seq) ORDER BY w.confidence DESC, seq LIMIT 1) AS top_title, 25e0 AS gap_percent FROM w")
def q28_verification_summary(spark, sf):
    s = _checked(spark, sf)
    return summaries.verification_summary(suggestions.verified(s).join(s.select("seq", "title"), "seq"), 300, 400)


#: Texts that bear keywords of every problem type.
INCIDENTS = ["service crash with SIGSEGV", "cannot start, not running", "OOM: out of memory", "memory leak in cache", "deadlock, hang", "slow throughput", "leak of handles", "all is well"]


def _incident_sql(kind: str) -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(INCIDENTS))
    has = lambda words: "(" + " OR ".join(f"contains(t, '{w}')" for w in words) + ")"
    case = " ".join(f"WHEN {has(w)} THEN " + (f"'{v}'" if v != "memory_" else "CASE WHEN contains(t, 'leak') OR contains(t, '泄漏') THEN 'memory_leak' ELSE 'page_fault' END") for w, v in diagnosis.PROBLEMS)
    return f"WITH i(k, s) AS (VALUES {values}), d AS (SELECT turn, conv_id, lower(text || ' ' || s) AS t, s FROM conversations JOIN i ON conv_id % 8 = k), c AS (SELECT conv_id, turn, s, CASE {case} ELSE 'performance' END AS problem FROM d) {kind}"


def _incidents(spark, sf):
    i = F.broadcast(spark.createDataFrame(list(enumerate(INCIDENTS)), "k long, s string"))
    c = S.table(spark, sf, "conversations").withColumn("k", F.col("conv_id") % 8).join(i, "k")
    return c.select("conv_id", "turn", "s", diagnosis.problem_type(F.col("text"), F.col("s")).alias("problem"))


@query(_incident_sql("SELECT conv_id, turn, problem FROM c"))
def q29_classify_problem(spark, sf):
    return _incidents(spark, sf).select("conv_id", "turn", "problem")


@query(_incident_sql("""SELECT conv_id, turn, CASE WHEN problem = 'crash' THEN 'critical' WHEN problem = 'startup_failure' THEN 'high' WHEN contains(s, 'SIGSEGV') OR contains(s, 'SIGABRT') OR contains(s, 'OOM') OR contains(s, '段错误') THEN 'critical'
 WHEN contains(s, 'leak') OR contains(s, 'deadlock') OR contains(s, '内存泄漏') OR contains(s, '死锁') THEN 'high' ELSE 'medium' END AS severity FROM c"""))
def q30_severity(spark, sf):
    return _incidents(spark, sf).select("conv_id", "turn", diagnosis.severity(F.col("problem"), F.array("s")).alias("severity"))


@query("""SELECT conv_id, least((CASE WHEN count(*) >= 5 THEN 70 WHEN count(*) >= 3 THEN 60 ELSE 50 END) + 5 * count(*) FILTER (WHERE role = 'user' AND coalesce(text, '') <> ''), 95) / 100e0 AS confidence FROM conversations GROUP BY 1""")
def q31_diag_confidence(spark, sf):
    c = S.table(spark, sf, "conversations").select("conv_id", F.col("text").alias("stdout"), F.lit("").alias("stderr"), F.when(F.col("role") == "user", 0).otherwise(1).alias("returncode"))
    return diagnosis.confidence(c, "conv_id")


#: Words that lead to every category and every bottleneck, and one that leads to none.
WORDS = ["Raft", "skiplist", "rpc", "mutex", "batch", "window", "lease", "fsync", "search", "timeout", "plain"]


def _with_word(spark, sf):
    """Suggestions whose titles end in one of the words."""
    word = F.element_at(F.array(*map(F.lit, WORDS)), (F.col("seq") % len(WORDS)).cast("int") + 1)
    return S.suggestions(spark, sf).withColumn("title", F.concat("title", F.lit(" "), word))


WORDY = f"WITH {SUG}, t AS (SELECT seq, lower(title || ' ' || {stop(WORDS)}[(seq % {len(WORDS)})::INT + 1] || ' ' || description) AS t FROM sug)"


@query(f"{WORDY}, c AS (SELECT CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{v}'" for words, v in suggestions.CATEGORIES) + " ELSE 'other' END AS category FROM t) SELECT category, count(*) AS n FROM c GROUP BY 1")
def q32_category_buckets(spark, sf):
    return suggestions.categories(_with_word(spark, sf)).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


TEXT_STD = "'QPS: ' || event_id || '.5' || chr(10) || 'Avg Latency: ' || (event_id % 97) || '.25 ms' || chr(10) || 'P99 Latency: ' || (event_id % 301) || ' ms' || chr(10) || 'Error Rate: ' || (event_id % 7) || '%'"
TEXT_ZH = "(event_id % 997) || '.5 ops/s' || chr(10) || '平均延迟: ' || (event_id % 97) || '.25 ms' || chr(10) || 'p99 延迟: ' || (event_id % 301) || '.5 ms'"


def _output(spark, sf, text: str) -> DataFrame:
    return S.table(spark, sf, "events").select("event_id", F.expr(text).alias("output"))


@query("SELECT event_id, event_id + 0.5e0 AS qps, (event_id % 97) + 0.25e0 AS avg_latency, 0e0 AS p50_latency, (event_id % 301)::DOUBLE AS p99_latency, CASE WHEN event_id % 7 > 1 THEN (event_id % 7) / 100e0 ELSE (event_id % 7)::DOUBLE END AS error_rate FROM events")
def q33_parse_bench_standard(spark, sf):
    return parsers.bench_metrics(_output(spark, sf, TEXT_STD), "output", "standard").drop("output")


@query("SELECT event_id, (event_id % 997) + 0.5e0 AS qps, (event_id % 97) + 0.25e0 AS avg_latency, 0e0 AS p50_latency, (event_id % 301) + 0.5e0 AS p99_latency, 0e0 AS error_rate FROM events")
def q34_parse_bench_cascade(spark, sf):
    return parsers.bench_metrics(_output(spark, sf, TEXT_ZH), "output").drop("output")


@query("""SELECT event_type, list_sort(list(v))[least(floor(count(*) * 0.99e0)::INT, count(*)::INT - 1) + 1] * 1000 AS p99_ms FROM (SELECT event_type, (event_id % 1000) / 1000e0 AS v FROM events) GROUP BY 1""")
def q35_nearest_rank_p99(spark, sf):
    e = S.table(spark, sf, "events").select("event_type", F.concat(F.lit("# Query_time: 0."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("  Lock_time: 0")).alias("line"))
    v = e.select("event_type", parsers.number(F.col("line"), r"Query_time:\s+([\d.]+)").alias("v"))
    return history.nearest_rank(v, "event_type", "v", {"p": 0.99}).select("event_type", (F.col("p") * 1000).alias("p99_ms"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2")
def q36_log_tail_per_file(spark, sf):
    return parsers.tail(S.table(spark, sf, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn")


@query("""WITH a AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM a WHERE r <= 20 AND event_type = 'error')
SELECT user_id, event_id FROM b WHERE k <= 2""")
def q37_error_log_filter(spark, sf):
    return parsers.error_lines(S.table(spark, sf, "events"), "user_id", "event_type", "event_id", 20, 2).select("user_id", "event_id")


@query("""WITH l AS (SELECT user_id % 200 AS cluster, event_type, user_id % 3 AS term FROM events), a AS (SELECT cluster, bool_or(event_type IN ('click', 'view')) AS leader, bool_or(event_type = 'view') AS ready, count(term) AS n_terms, count(DISTINCT term) AS kinds FROM l GROUP BY 1),
b AS (SELECT *, CASE WHEN NOT leader THEN 'no_leader' WHEN NOT ready THEN 'not_ready' WHEN n_terms < 3 THEN 'few_logs' WHEN kinds = 1 THEN 'healthy' ELSE 'terms_differ' END AS reason FROM a) SELECT cluster, leader, ready, n_terms, reason, reason = 'healthy' AS healthy FROM b""")
def q38_cluster_health(spark, sf):
    e = S.table(spark, sf, "events")
    word = F.when(F.col("event_type") == "click", "I am the leader").when(F.col("event_type") == "view", "Leader election complete").otherwise("idle")
    return diagnosis.cluster_health(e.select((F.col("user_id") % 200).alias("cluster"), F.col("event_id").alias("node"), F.concat(word, F.lit(" term{"), (F.col("user_id") % 3).cast("string"), F.lit("}")).alias("content")), "cluster")


LEVELS = "lev AS (SELECT p_brand AS brand, p_size AS level, count(*)::DOUBLE AS actual_qps, max(p_retailprice) AS p99_latency, (sum(p_partkey) % 100) / 1000e0 AS error_rate, sum(p_partkey) % 5 <> 0 AS success FROM part GROUP BY 1, 2)"


def _levels(spark, sf):
    k = F.sum("p_partkey")
    return S.table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").alias("level")).agg(F.count(F.lit(1)).cast("double").alias("actual_qps"), F.max("p_retailprice").alias("p99_latency"), ((k % 100) / F.lit(1000.0)).alias("error_rate"), (k % 5 != 0).alias("success"))


@query(f"""WITH {LEVELS}, o AS (SELECT *, bool_or(error_rate >= 0.05e0) OVER (PARTITION BY brand ORDER BY level) AS over FROM lev WHERE success)
SELECT brand, coalesce(max(actual_qps) FILTER (WHERE NOT over), 0) AS max_achievable, min(level) FILTER (WHERE error_rate >= 0.05e0) AS bottleneck FROM o GROUP BY 1""")
def q39_saturation_takewhile(spark, sf):
    return history.saturation(_levels(spark, sf), "brand")


@query(f"""WITH {LEVELS}, s AS (SELECT *, 0.6e0 * actual_qps / 400 + 0.4e0 * (10e0 / (p99_latency + 0.1e0)) AS score FROM lev WHERE success AND error_rate < 0.05e0), t AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY score DESC, level) AS r FROM s)
SELECT b.brand, coalesce(level, 0) AS level, coalesce(actual_qps, 0) AS actual_qps, coalesce(p99_latency, 0) AS p99_latency, coalesce(score, 0) AS score, CASE WHEN level IS NULL THEN 4 ELSE greatest(2, least(16, trunc(actual_qps / 90)::INT + 1)) END AS threads, CASE WHEN level IS NULL THEN 100 ELSE 200 END AS ops
FROM (SELECT DISTINCT brand FROM lev) b LEFT JOIN t ON t.brand = b.brand AND r = 1""")
def q40_optimal_config(spark, sf):
    return history.optimal_config(_levels(spark, sf), "brand")


@query("""WITH r AS (SELECT o_orderkey AS k, l_linenumber AS pos, round(l_quantity)::INT AS q, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pos, q::VARCHAR) AS n FROM r WHERE q + 0.25e0 > 0.5e0)
SELECT k, q + 0.25e0 AS percent, 'f' || pos AS name, (6 - n)::INT AS priority FROM f WHERE n <= 5""")
def q41_hotspot_topk(spark, sf):
    line = F.concat(F.lit("  "), F.round("l_quantity").cast("int").cast("string"), F.lit(".25%  f"), F.col("l_linenumber").cast("string"))
    text = S.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("x")))).alias("a"))
    text = text.select("k", F.array_join(F.transform("a", lambda x: x.x), "\n").alias("report")).join(S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), "k")
    return parsers.hotspots(text, "report", "k")


@query("SELECT event_id, i::INT AS frame, '0x' || format('{:x}', event_id + 16) AS address, 'f' || (event_id % 9) AS function FROM events, (VALUES (0), (1)) v(i)")
def q42_gdb_frames(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", F.expr("'#0  0x' || lower(hex(event_id + 16)) || ' in f' || event_id % 9 || ' ()\n#1  0x' || lower(hex(event_id + 16)) || ' in f' || event_id % 9 || ' ()\n#2  0x1 in g (x=1)'").alias("t"))
    return parsers.gdb_frames(e, "t", "event_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE 'src/a' || (event_id % 10) || '.cpp' END AS file, CASE event_id % 4 WHEN 3 THEN 0 ELSE (event_id % 500)::INT END AS line_start, CASE event_id % 4 WHEN 3 THEN 0 ELSE (event_id % 500)::INT + 5 END AS line_end FROM events""")
def q43_location_parse(spark, sf):
    text = "'src/a' || event_id % 10 || '.cpp' || CASE event_id % 4 WHEN 0 THEN ':' || event_id % 500 WHEN 1 THEN ' line ' || event_id % 500 WHEN 2 THEN ' 第 ' || event_id % 500 || ' 行' ELSE '' END"
    return parsers.location(_output(spark, sf, text), "output").drop("output")


@query("""WITH s AS (SELECT doc_id AS seq, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 400)::VARCHAR END AS file, (doc_id % 9)::INT AS ln FROM documents), j AS (SELECT seq, file, ln, html IS NOT NULL AS found, string_split(html, chr(10)) AS l FROM s LEFT JOIN pages ON file = page_id::VARCHAR)
SELECT seq, found, CASE WHEN file IS NULL THEN '无法解析代码位置' WHEN NOT found THEN '文件不存在: ' || file ELSE '' END AS issue, CASE WHEN found THEN array_to_string(list_transform(range(greatest(1, ln - 3), least(ln + 3, len(l)) + 1), lambda i: (CASE WHEN i = ln THEN '>>> ' ELSE '    ' END) || lpad(i::VARCHAR, 4, ' ') || ': ' || l[i]), chr(10)) ELSE '' END AS snippet FROM j""")
def q44_location_left_join(spark, sf):
    files = S.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    k = F.col("doc_id")
    s = S.table(spark, sf, "documents").select(k.alias("seq"), F.when(k % 5 > 0, (k % 400).cast("string")).alias("file"), (k % 9).cast("int").alias("line_start"))
    none = F.lit("")
    return suggestions.located(s, files).select("seq", "found", F.coalesce("issue", none).alias("issue"), F.coalesce("snippet", none).alias("snippet"))


CODES = ["f(a", "x[1]]", "while (lock(m)) {}", "delete p; Lock(m)", "memcpy(a, b)", "  ", "{ (", "int x;"]


def _count_sql(ch: str) -> str:
    return f"len(c) - len(replace(c, '{ch}', ''))"


@query(f"""WITH d AS (SELECT doc_id AS seq, {stop(CODES)}[(doc_id % 8)::INT + 1] AS c FROM documents) SELECT seq, trim(c) = '' AS blank, {_count_sql('{')} = {_count_sql('}')} AS braces, {_count_sql('(')} = {_count_sql(')')} AS parens, {_count_sql('[')} = {_count_sql(']')} AS brackets,
 contains(c, 'while') AND contains(lower(c), 'lock') AS loop_lock, contains(c, 'delete') AND contains(lower(c), 'lock') AS delete_lock, contains(c, 'memcpy') AS memcpy FROM d""")
def q45_syntax_checks(spark, sf):
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("seq") % 8).cast("int") + 1)
    return S.suggestions(spark, sf).select("seq", suggestions.syntax_checks(code).alias("c")).select("seq", "c.*")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, array_to_string(list_transform(range(1, least(6, len(l)) + 1), lambda i: (CASE WHEN i = 3 THEN '>>> ' ELSE '    ' END) || lpad(i::VARCHAR, 4, ' ') || ': ' || l[i]), chr(10)) AS snippet FROM l""")
def q46_snippet_slice(spark, sf):
    return parsers.snippet(S.table(spark, sf, "documents").select("doc_id", "text"), "text", F.lit(3)).select("doc_id", "snippet")


#: Answers (§ is an event's id, @ its type) and the suggestions that they hold: title, description, pseudocode, priority, risk, gain, steps, confidence.
PLAIN = ("", "# 无伪代码", 3, "medium", "未知", 0, 0.5)
ANSWERS = [
    ('[{"title": "t§", "priority": 9, "risk_level": "low", "self_confidence": 3}, {"title": "u@", "priority": -2, "risk_level": "LOW"}]', [("t§", "", "# 无伪代码", 5, "low", "未知", 0, 1.0), ("u@", "", "# 无伪代码", 1, "low", "未知", 0, 0.5)]),
    ('so:\n```json\n[{"title": "t§", "description": "@", "pseudocode": "f(§)", "implementation_steps": ["a", "b"], "expected_gain": "§%"}]\n```', [("t§", "@", "f(§)", 3, "medium", "§%", 2, 0.5)]),
    ('{"suggestions": [{"title": "t§", "priority": "4", "self_confidence": "0.9"}, {"title": "gone", "priority": "4.5"}, 5]}', [("t§", "", "# 无伪代码", 4, "medium", "未知", 0, 0.9)]),
    ('```json\n{"suggestions": [{"title": "t§"}]}\n```', [("未命名建议", *PLAIN)]),
    ("##@ t§\ntext\n### more\n", [("@ t§", "（解析失败，请参考原文）", "# 解析失败", 3, "medium", "未知", 1, 0.3), ("more", "（解析失败，请参考原文）", "# 解析失败", 3, "medium", "未知", 1, 0.3)]),
    ('{"other": §}', []),
    ('[{"title": "a§", "risk_level": " low "}, {"title": "b§", "priority": null}, {"title": "c§", "self_confidence": "high"}, {"title": "t§", "priority": 4.7, "risk_level": 3}]', [("t§", "", "# 无伪代码", 4, "medium", "未知", 0, 0.5)]),
    ('[{"title": "t§", "implementation_steps": "do it"}, {"title": "u§", "implementation_steps": 5}]', [("t§", "", "# 无伪代码", 3, "medium", "未知", 1, 0.5), ("u§", *PLAIN)]),
    ('```\n{broken\n``` or ```json\n{"title": "t§", "risk_level": "High"}\n```', [("t§", "", "# 无伪代码", 3, "high", "未知", 0, 0.5)]),
    ('{"suggestions": 5}', []),
    ("```\n§\n``` ```json\n[{}]\n```", []),
    ('[{"title": 7, "confidence": 0.9}, [], null, {"expected_gain": "§"}]', [("7", *PLAIN), ("未命名建议", "", "# 无伪代码", 3, "medium", "§", 0, 0.5)]),
]


def _answers_sql(cases: list, names: str) -> str:
    def text(x) -> str:
        return "'" + x.replace("'", "''").replace("§", "' || event_id || '").replace("@", "' || event_type || '") + "'" if isinstance(x, str) else f"{x!r}e0" if isinstance(x, float) else repr(x)

    parts = [f"SELECT event_id, {pos}, {', '.join(map(text, r))} FROM events WHERE event_id % {len(cases)} = {k}" for k, (_, rows) in enumerate(cases) for pos, r in enumerate(rows)]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) v(event_id, pos, {names})"


def _answers(spark, sf, cases) -> DataFrame:
    """event_id, output: an answer for each event, with its id and type in it."""
    dim = F.broadcast(spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k long, answer string"))
    e = S.table(spark, sf, "events").withColumn("k", F.pmod("event_id", F.lit(len(cases)))).join(dim, "k")
    return e.select("event_id", F.replace(F.replace(F.col("answer"), F.lit("§"), F.col("event_id").cast("string")), F.lit("@"), F.col("event_type")).alias("output"))


@query(_answers_sql(ANSWERS, "title, description, pseudocode, priority, risk_level, expected_gain, n_steps, confidence"))
def q47_json_suggestions(spark, sf):
    out = responses.suggestions_of(_answers(spark, sf, ANSWERS), "output", "event_id")
    return out.withColumn("n_steps", F.size("steps")).drop("steps")


@query("SELECT o_orderkey AS seq, substring(md5(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ':' || o_custkey || ':' || o_orderkey), 1, 12) AS record_id FROM orders")
def q48_record_id_md5(spark, sf):
    o = S.table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("actual_qps"), F.col("o_orderkey").alias("target_qps"))
    return sinks.with_record_id(o).select("seq", "record_id")


@query(f"""WITH {SUG} SELECT seq, CASE WHEN n_steps = 0 THEN '无法估算（代码位置无效）' WHEN priority >= 4 AND risk_level = 'low' THEN '预期收益高，风险低，建议优先实施' WHEN priority >= 4 AND risk_level = 'medium' THEN '预期收益高，需谨慎实施，建议先在测试环境验证'
 WHEN priority >= 4 THEN '预期收益高，但风险也高，建议最后实施' WHEN priority >= 3 THEN '预期收益中等，可以考虑实施' ELSE '优先级较低，可以延后处理' END AS impact FROM sug""")
def q49_impact_labels(spark, sf):
    return S.suggestions(spark, sf).select("seq", M.impact(F.col("priority"), F.col("risk_level"), F.col("n_steps") > 0).alias("impact"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS ts, event_type, count(*) AS n, sum(value::DECIMAL(20,6))::DOUBLE AS total FROM events GROUP BY 1, 2")
def q50_stream_daily_counts(spark, sf):
    return observe.replay(spark, sf)


@query(f"WITH {SUG} SELECT seq, CASE WHEN contains(source_model, '1') THEN 1.2e0 ELSE 0.7e0 END AS weight, [1.5e0, 1.3e0, 0.9e0, 1.2e0][(seq % 4)::INT + 1] AS claude_weight FROM sug")
def q51_default_weights(spark, sf):
    name = F.when(F.col("source_model").contains("1"), F.concat(F.lit("GPT-4-"), "source_model")).otherwise(F.col("source_model"))
    return S.suggestions(spark, sf).select("seq", M.default_weight(name).alias("weight"), M.default_weight(F.element_at(F.array(*map(F.lit, ["Claude-Opus", "claude-sonnet-x", "haiku", "other"])), (F.col("seq") % 4).cast("int") + 1), claude_like=True).alias("claude_weight"))


@query("SELECT event_id, (event_id % 900 + 1) / 2e0 AS qps, (event_id % 50) / 1000e0 AS avg_latency, (event_id % 50) / 1000e0 * 0.8e0 AS p50_latency, (event_id % 50) / 1000e0 * 2 AS p99_latency FROM events")
def q52_parse_redis(spark, sf):
    text = "'SET: ' || (event_id % 900 + 1) || ' requests in 2.0 s' || chr(10) || 'Latency: ' || event_id % 50 || ' us'"
    return parsers.redis_metrics(_output(spark, sf, text), "output").drop("output")


@query(f"""WITH {SUG}, {SETS}, r AS (SELECT *, row_number() OVER (ORDER BY CASE risk_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, final_weight DESC, priority DESC, seq)::INT AS rank FROM weights WHERE {GOOD} ORDER BY rank LIMIT 5)
SELECT '# Suggestions' || chr(10) || chr(10) || string_agg('## ' || rank || '. ' || title || chr(10) || chr(10) || '- model: ' || source_model || chr(10) || '- risk: ' || risk_level || chr(10) || '- priority: ' || priority || chr(10) || chr(10) || description || chr(10), chr(10) ORDER BY rank) AS report FROM r""")
def q53_markdown_report(spark, sf):
    return sinks.markdown_report("Suggestions", suggestions.top_ranked(suggestions.quality_filter(_weighted(spark, sf)), 5))


def _state(spark, sf):
    """The latest snapshot, at a rate of some hundreds a second."""
    return summaries.latest(S.snapshots(spark, sf), 1).withColumn("qps", F.col("qps") * 50000).withColumn("target_qps", F.lit(200.0))


def _stepped(spark, sf):
    steps = F.slice(F.array(F.lit("build"), F.lit("test"), F.lit("ship")), 1, F.col("n_steps"))
    return _ranked(spark, sf, 5).withColumn("steps", steps)


STEPPED = f"""WITH {SUG}, {SETS}, {SNAP}, m AS (SELECT qps * 50000 AS qps, avg_latency, p50_latency, p99_latency, error_rate FROM snap ORDER BY ts DESC LIMIT 1),
r AS (SELECT *, row_number() OVER (ORDER BY CASE risk_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, final_weight DESC, priority DESC, seq)::INT AS rank, ['build', 'test', 'ship'][1:n_steps] AS steps FROM weights WHERE {GOOD} ORDER BY rank LIMIT 5)"""


@query(STEPPED + """, t AS (SELECT rank, concat_ws(chr(10) || chr(10), '### ' || rank || '. ' || title || chr(10) || chr(10) || '- priority: ' || repeat('*', priority) || CASE WHEN priority >= 4 THEN ' high' WHEN priority >= 2 THEN ' medium' ELSE ' low' END || chr(10) || '- risk: ' || risk_level || chr(10) || '- gain: ' || expected_gain || chr(10) || '- model: ' || source_model || chr(10) || '- confidence: ' || printf('%.0f', self_confidence * 100) || '%',
 description, '```' || chr(10) || pseudocode || chr(10) || '```', CASE WHEN len(steps) > 0 THEN array_to_string(list_transform(steps, lambda x, i: i || '. ' || x), chr(10)) END) || chr(10) AS body FROM r),
k AS (SELECT risk_level, '- ' || title AS line, rank, row_number() OVER (PARTITION BY risk_level ORDER BY rank) AS i FROM r),
g AS (SELECT CASE risk_level WHEN 'low' THEN '**1. Low risk (at once)**' WHEN 'medium' THEN '**2. Medium risk (after tests)**' ELSE '**3. High risk (after review)**' END AS head, string_agg(line, chr(10) ORDER BY rank) AS lines FROM k WHERE i <= 2 GROUP BY 1)
SELECT concat_ws(chr(10) || chr(10), '# Optimization', '| metric | now | target | state |' || chr(10) || '|:-|:-|:-|:-|' || chr(10) || '| QPS | ' || printf('%.1f', qps) || ' | 200.0 | ' || CASE WHEN qps >= 200 THEN 'reached' ELSE 'short by ' || printf('%.1f', (200e0 - qps) / 200e0 * 100) || '%' END || ' |' || chr(10)
 || '| average latency | ' || printf('%.2f', avg_latency) || ' ms | - | - |' || chr(10) || '| P50 latency | ' || printf('%.2f', p50_latency) || ' ms | - | - |' || chr(10) || '| P99 latency | ' || printf('%.2f', p99_latency) || ' ms | - | - |' || chr(10) || '| error rate | ' || printf('%.2f', error_rate * 100) || '% | < 1% | ' || CASE WHEN error_rate < 0.01e0 THEN 'good' ELSE 'bad' END || ' |',
 (SELECT '## ' || count(*) || ' suggestions' FROM r), (SELECT string_agg(body, chr(10) ORDER BY rank) FROM t), '## Order', (SELECT string_agg(head || chr(10) || lines, chr(10) || chr(10) ORDER BY head) FROM g), '## Verification', '""" + "\n".join(reports.VERIFY).replace("'", "''") + """') AS report FROM m""")
def q105_optimization_report(spark, sf):
    return reports.optimization_report(_state(spark, sf), _stepped(spark, sf))


@query(STEPPED + """ SELECT concat_ws(chr(10) || chr(10), 'QPS ' || printf('%.1f', qps) || ' of 200.0', (SELECT string_agg(rank || '. **' || title || '** (' || risk_level || ' risk)' || chr(10) || '   ' || substring(description, 1, 80) || '...', chr(10) ORDER BY rank) FROM r WHERE rank <= 3)) AS report FROM m""")
def q106_short_summary(spark, sf):
    return reports.short_summary(_state(spark, sf), _stepped(spark, sf))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'deepseek' WHEN page_id % 4 = 1 THEN 'dashscope' WHEN page_id % 4 = 2 THEN 'openai' ELSE 'openai-compatible' END AS provider FROM pages")
def q54_provider(spark, sf):
    k = F.col("page_id") % 4
    url = F.when(k == 0, "https://api.DeepSeek.com").when(k == 2, "https://api.openai.com").otherwise("https://localhost")
    return S.table(spark, sf, "pages").select("page_id", M.provider(url, F.when(k == 1, "Qwen-plus").otherwise("m")).alias("provider"))


@query("SELECT user_id, CASE WHEN count(*) > 0 THEN (count(*) FILTER (WHERE event_type = 'error'))::DOUBLE / count(*) ELSE 0 END AS error_rate, CASE WHEN (sum(event_id) % 7) > 0 THEN count(*)::DOUBLE / (sum(event_id) % 7)::BIGINT ELSE 0 END AS qps FROM events GROUP BY 1")
def q55_status_ratios(spark, sf):
    n = F.count(F.lit(1))
    return S.table(spark, sf, "events").groupBy("user_id").agg(M.ratio(F.count_if(F.col("event_type") == "error"), n).alias("error_rate"), M.ratio(n, F.sum("event_id") % 7).alias("qps"))


@query("""WITH e AS (SELECT event_id, event_id % 11 AS k, floor(value * 100)::BIGINT AS v FROM events) SELECT event_id, CASE WHEN k = 3 THEN 0 ELSE v::DOUBLE END AS qps, CASE WHEN k IN (3, 5) THEN 0 ELSE (v % 700) / 1000e0 END AS avg_latency,
 CASE WHEN k IN (3, 5) THEN 0 ELSE (v % 700) / 1000e0 * 0.8e0 END AS p50_latency, CASE WHEN k IN (3, 5) THEN 0 ELSE (v % 700) / 1000e0 * 2 END AS p99_latency, CASE WHEN k = 3 THEN 1 WHEN k = 7 OR event_id = 0 THEN 0 ELSE (v % 9)::DOUBLE / event_id END AS error_rate FROM e""")
def q102_redis_info(spark, sf):
    e, v = S.table(spark, sf, "events"), F.floor(F.col("value") * 100).cast("long")
    k, at = F.col("event_id") % 11, lambda name, x: F.concat(F.lit(f"{name}:"), x.cast("string"))
    rate = F.when(k == 3, "many").otherwise(v.cast("string"))
    text = F.concat_ws("\r\n", F.lit("# Stats"), at("instantaneous_ops_per_sec", rate), F.when(k != 5, at("avg_cmd_latency_us", v % 700)), at("total_commands_processed", F.when(k == 7, "?").otherwise(F.col("event_id").cast("string"))), at("rejected_commands", v % 9))
    return parsers.redis_info_metrics(e.select("event_id", text.alias("info")), "info").drop("info")


@query("""WITH u AS (SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS e, list_sort(list(floor(value * 100)::BIGINT / 1000e0) FILTER (WHERE event_type <> 'error')) AS s FROM events GROUP BY 1)
SELECT user_id, CASE WHEN user_id % 6 > 0 THEN n::DOUBLE / (user_id % 6) ELSE 0 END AS qps, 1e0 AS avg_latency, 0.9e0 AS p50_latency, CASE WHEN len(s) > 0 THEN s[least(floor(len(s) * 0.99e0)::INT, len(s)::INT - 1) + 1] * 1000 ELSE 10 END AS p99_latency, CASE WHEN user_id % 4 = 0 THEN 0 ELSE e::DOUBLE / n END AS error_rate FROM u""")
def q103_mysql_status(spark, sf):
    e = S.table(spark, sf, "events").withColumn("bad", F.col("event_type") == "error")
    n, u = F.count(F.lit(1)), F.col("user_id")
    line = lambda name, x: F.concat(F.lit(f"{name}\t"), x.cast("string"))
    text = F.concat_ws("\n", line("Questions", n), line("Uptime", u % 6), F.when(u % 4 > 0, line("Aborted_connects", F.count_if("bad"))), line("Connections", n))
    status = e.groupBy("user_id").agg(text.alias("status"))
    slow = parsers.slow_times(e.where("not bad").select("user_id", F.concat(F.lit("# Query_time: "), (F.floor(F.col("value") * 100) / 1000).cast("string")).alias("line")), F.col("line"), "user_id")
    return parsers.mysql_metrics(status, "status", "user_id", slow)


@query(f"""WITH {SNAP} SELECT count(*) AS n, sum(qps::DECIMAL(30,12))::DOUBLE / count(*) AS avg_qps, max(qps) AS max_qps, min(qps) AS min_qps, sum(avg_latency::DECIMAL(30,12))::DOUBLE / count(*) AS avg_latency, count(*) * 60e0 AS duration FROM snap""")
def q56_sample_summary(spark, sf):
    return summaries.sample_summary(S.snapshots(spark, sf))


@query(f"""WITH {SUG}, {SETS} SELECT seq, priority, final_weight, row_number() OVER (ORDER BY final_weight DESC, priority DESC, seq)::INT AS rank FROM weights WHERE risk_level = 'medium' AND priority >= 4 ORDER BY rank LIMIT 5""")
def q57_top_by_risk_and_priority(spark, sf):
    s = S.suggestions(spark, sf)
    return suggestions.top_weighted(s, S.model_history(spark, sf), of=suggestions.chosen(s, 1, 4)).select("seq", "priority", "final_weight", "rank")


@query(f"WITH {SUG} SELECT seq, risk_level, priority, row_number() OVER (ORDER BY risk_level = 'low', priority DESC, seq)::INT AS step FROM sug ORDER BY step LIMIT 5")
def q58_roadmap(spark, sf):
    return suggestions.roadmap(S.suggestions(spark, sf)).select("seq", "risk_level", "priority", "step")


@query(f"{WORDY} SELECT seq, CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{w}')" for w in words) + f" THEN '{v}'" for words, v in suggestions.BOTTLENECKS) + " ELSE 'none' END AS file FROM t")
def q59_bottleneck_file(spark, sf):
    return suggestions.related_file(_with_word(spark, sf)).select("seq", F.coalesce("file", F.lit("none")).alias("file"))


def _with_term(spark, sf):
    """Suggestions whose titles end in a technical term."""
    return S.suggestions(spark, sf).withColumn("title", F.concat("title", F.lit(" "), F.element_at(F.array(*map(F.lit, suggestions.TERMS)), (F.col("seq") % 21).cast("int") + 1)))


@query(f"WITH {SUG}, t AS (SELECT seq, lower(title || ' ' || {stop(suggestions.TERMS)}[(seq % 21)::INT + 1] || ' ' || description) AS t FROM sug) SELECT seq, term FROM t, (SELECT unnest({stop(suggestions.TERMS)}) AS term) WHERE contains(t, lower(term))")
def q60_technical_terms(spark, sf):
    return suggestions.lowered(_with_term(spark, sf), "title", "description").select("seq", F.explode(suggestions.terms(F.col("low"))).alias("term"))


@query(f"""WITH {SUG}, term AS (SELECT unnest({stop(suggestions.TERMS)}) AS term, generate_subscripts({stop(suggestions.TERMS)}, 1) AS no), mine AS (SELECT seq, term, no FROM sug JOIN term ON contains(lower(title || ' ' || {stop(suggestions.TERMS)}[(seq % 21)::INT + 1] || ' ' || description), lower(term))),
f AS (SELECT conv_id::VARCHAR AS path, string_split(string_agg(text, chr(10) ORDER BY turn, text) || chr(10) || 'the log of a Batch' || chr(10) || 'end', chr(10)) AS l FROM conversations GROUP BY 1), n AS (SELECT path, l, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos FROM f),
h AS (SELECT path, term, min(pos) AS pos, any_value(l) AS l FROM n JOIN term ON contains(lower(line), lower(term)) GROUP BY 1, 2), b AS (SELECT seq, path, h.pos, l, row_number() OVER (PARTITION BY seq ORDER BY path, no, h.pos) AS k FROM mine JOIN h USING (term))
SELECT seq, path, pos::INT AS pos, array_to_string(l[greatest(pos - 1, 1):least(pos + 5, len(l))], chr(10)) AS code FROM b WHERE k = 1""")
def q61_related_code(spark, sf):
    files = S.table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text), "\n").alias("content"))
    files = files.withColumn("content", F.concat("content", F.lit("\nthe log of a Batch\nend")))
    return suggestions.related_code(_with_term(spark, sf), files)


@query(f"""WITH {MET} SELECT event_id, array_to_string(list_filter([CASE WHEN qps >= 350 THEN 'qps' END, CASE WHEN avg_latency <= 5 THEN 'avg_latency' END, CASE WHEN p99_latency <= 15 THEN 'p99_latency' END, CASE WHEN error_rate < 0.01e0 THEN 'error_rate' END], lambda x: x IS NOT NULL), '|') AS strong,
 array_to_string(list_filter([CASE WHEN qps < 200 THEN 'qps' END, CASE WHEN avg_latency > 10 THEN 'avg_latency' END, CASE WHEN p99_latency > 50 THEN 'p99_latency' END, CASE WHEN error_rate > 0.05e0 THEN 'error_rate' END], lambda x: x IS NOT NULL), '|') AS weak FROM met""")
def q62_strengths(spark, sf):
    c = [F.col(x) for x in ("qps", "avg_latency", "p99_latency", "error_rate")]
    return _metrics(spark, sf).select("event_id", F.array_join(M.strengths(*c), "|").alias("strong"), F.array_join(M.bottlenecks(*c), "|").alias("weak"))


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')")
def q63_enabled_models(spark, sf):
    return summaries.named(S.table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["user", "assistant"], "role")


@query("SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant') AND (length(text) % 3 <> 0 OR conv_id % 5 = 0)")
def q104_switched_on(spark, sf):
    on = F.when(F.col("conv_id") % 5 > 0, F.length("text") % 3 != 0)
    return summaries.enabled(S.table(spark, sf, "conversations").select("conv_id", "turn", "role", on.alias("enabled")), ["user", "assistant"], "role").drop("enabled")


@query("SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) WHERE r = 1) WHERE k <= 10")
def q64_distinct_commands_capped(spark, sf):
    return summaries.first_distinct(S.table(spark, sf, "conversations").select("conv_id", "role", "turn"), "role", ["turn"], 10, ["conv_id"])


MIXED = "CASE event_id % 5 WHEN 0 THEN 'QPS: ' || event_id || chr(10) || '错误率: ' || event_id % 9 WHEN 1 THEN 'p95 延迟: 7.5 ms, Error Rate: 3%' WHEN 2 THEN 'Error Rate: ' || event_id % 9 || '%' WHEN 3 THEN 'Throughput: ' || event_id || ' Median latency: 3.5' ELSE 'nothing' END"


@query("""SELECT event_id, CASE WHEN event_id % 5 IN (0, 3) THEN event_id::DOUBLE ELSE 0 END AS qps, 0e0 AS avg_latency, CASE WHEN event_id % 5 = 3 THEN 3.5e0 ELSE 0 END AS p50_latency, 0e0 AS p99_latency,
 CASE WHEN event_id % 5 IN (0, 2) THEN CASE WHEN event_id % 9 > 1 THEN (event_id % 9) / 100e0 ELSE (event_id % 9)::DOUBLE END ELSE 0 END AS error_rate FROM events""")
def q65_parse_bench_mixed(spark, sf):
    return parsers.bench_metrics(_output(spark, sf, MIXED), "output").drop("output")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (event_id + 10) / 2.5e0 ELSE 77 END AS qps, CASE WHEN event_id % 2 = 0 THEN (event_id % 30) + 0.5e0 ELSE 0 END AS avg_latency, 0e0 AS p50_latency, 0e0 AS p99_latency, 0e0 AS error_rate FROM events")
def q66_parse_sysbench(spark, sf):
    text = "CASE WHEN event_id % 2 = 0 THEN 'requests: ' || (event_id + 10) || ' in 2.5s' ELSE 'QPS: 77 requests: 1 in 1s' END || chr(10) || 'avg: ' || event_id % 30 || '.5  min: 0.1'"
    return parsers.sysbench_metrics(_output(spark, sf, text), "output").drop("output")


@query("""SELECT event_id, CASE WHEN event_id % 4 <> 3 THEN event_id % 50 ELSE -1 END AS term, event_id AS last_log_index, CASE WHEN event_id % 4 <> 2 THEN event_id % 7 ELSE -1 END AS commit_index, CASE WHEN event_id % 3 = 0 THEN 2 ELSE 0 END::INT AS n_errors, CASE WHEN event_id % 3 = 0 THEN 'ERROR a' || event_id END AS first_error FROM events""")
def q67_node_status(spark, sf):
    text = "CASE WHEN event_id % 4 <> 3 THEN 'term{' || event_id % 50 || '}' ELSE '' END || ' lastLogIndex: ' || event_id || CASE WHEN event_id % 4 <> 2 THEN ' commitIndex=' || event_id % 7 ELSE '' END || CASE WHEN event_id % 3 = 0 THEN chr(10) || '  ERROR a' || event_id || chr(10) || 'error b' || chr(10) || 'WRONG c' ELSE '' END"
    n = parsers.node_status(_output(spark, sf, text), "event_id", "output")
    return n.select("event_id", F.coalesce("term", F.lit(-1)).alias("term"), "last_log_index", F.coalesce("commit_index", F.lit(-1)).alias("commit_index"), F.size("errors").alias("n_errors"), F.get("errors", 0).alias("first_error"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'SIGSEGV' WHEN 1 THEN 'SIGABRT' END AS signal, (event_id % 3)::INT AS frames, 2::INT AS threads, CASE WHEN event_id % 3 > 0 THEN 'f' || event_id END AS top_function,
 CASE event_id % 3 WHEN 0 THEN '段错误 (SIGSEGV)' WHEN 1 THEN '程序中止 (SIGABRT)|查看崩溃函数' ELSE '查看崩溃函数' END AS advice FROM events""")
def q68_gdb_report(spark, sf):
    text = "CASE event_id % 3 WHEN 0 THEN 'Signal: SIGFPE' || chr(10) || 'Program terminated with signal SIGSEGV' WHEN 1 THEN 'Signal: SIGABRT' ELSE 'fine' END || chr(10) || '=== BACKTRACE ===' || repeat(chr(10) || '#0  0x1f in f' || event_id || ' ()', CAST(event_id % 3 AS INT)) || chr(10) || '#9  0x1f in g (x=1)' || chr(10) || '=== THREAD INFO ===' || chr(10) || '* 1 a' || chr(10) || '  2 b' || chr(10) || '=== END'"
    return parsers.gdb_report(_output(spark, sf, text), "output", "event_id").withColumn("advice", F.array_join("advice", "|"))


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN '%Cpu(s): ' || event_id % 4 || ' us' END AS snapshot, (event_id % 3)::INT AS n FROM events")
def q69_top_lines(spark, sf):
    text = "CASE WHEN event_id % 4 > 0 THEN '%Cpu(s): 9 us' || chr(10) || '%Cpu(s): ' || event_id % 4 || ' us' || chr(10) ELSE '' END || 'bash 1.0' || repeat(chr(10) || ' 77 kvserver 3.0', CAST(event_id % 3 AS INT))"
    return parsers.cpu_lines(_output(spark, sf, text), "output", "event_id", "kvserver").select("event_id", "snapshot", F.size("processes").alias("n"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'libm' || event_id || '.so => not found' ELSE '' END AS missing, CASE WHEN event_id % 5 > 0 THEN (event_id % 60) || 'Gi' END AS available FROM events")
def q70_libraries_and_memory(spark, sf):
    ldd = "'libc.so.6 => /lib/libc.so.6 (0x7f)' || CASE WHEN event_id % 2 = 0 THEN chr(10) || '\tlibm' || event_id || '.so => not found' ELSE '' END"
    free = "'total used free' || CASE WHEN event_id % 5 > 0 THEN chr(10) || 'Mem:  62Gi 4Gi 50Gi 1Mi 3Gi ' || event_id % 60 || 'Gi' ELSE '' END || chr(10) || 'Swap: 0B 0B 0B'"
    e = S.table(spark, sf, "events").select("event_id", F.expr(ldd).alias("ldd"), F.expr(free).alias("free"))
    return e.select("event_id", F.array_join(parsers.missing_libraries(F.col("ldd")), "|").alias("missing"), parsers.available_memory(F.col("free")).alias("available"))


@query("SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type <> 'view') = 0 THEN 10e0 ELSE list_sort(list((event_id % 1000) / 1000e0) FILTER (WHERE event_type <> 'view'))[least(floor((count(*) FILTER (WHERE event_type <> 'view')) * 0.99e0)::INT, (count(*) FILTER (WHERE event_type <> 'view'))::INT - 1) + 1] * 1000 END AS p99_ms FROM events GROUP BY 1")
def q71_slow_log_p99(spark, sf):
    e = S.table(spark, sf, "events")
    line = F.when(F.col("event_type") != "view", F.concat(F.lit("# Query_time: 0."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("  Lock_time: 0"))).otherwise("SELECT 1")
    return parsers.p99_or_default(parsers.slow_times(e.select("user_id", line.alias("line")), F.col("line"), "user_id"), e.select("user_id").distinct(), "user_id")


CASES = [("crash", "SIGSEGV in f", "libx not found, permission denied"), ("memory_leak", "definitely lost: 4,096 bytes in 2 blocks", "Leak summary"), ("page_fault", "", "OOM killer"), ("performance", "SIGSEGV", "leak not found")]


def _cases(spark, sf):
    """A case for each turn of each conversation: its text is the log and the beginning of what the command said."""
    dim = spark.createDataFrame([(i, *c) for i, c in enumerate(CASES)], "k long, problem string, said string, stderr string")
    c = S.table(spark, sf, "conversations").withColumn("k", (F.col("conv_id") + F.col("turn")) % 4).join(F.broadcast(dim), "k")
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("case_id"), "problem", "text", F.concat_ws("\n", "text", "said").alias("stdout"), "stderr")


def _some_sql(*cases: str) -> str:
    return f"list_filter([{', '.join(f'CASE WHEN {c} END' for c in cases)}], lambda x: x IS NOT NULL)"


CASE_SQL = f"""WITH dim(k, problem, said, stderr) AS (VALUES {", ".join(f"({i}, '{p}', '{a}', '{b}')" for i, (p, a, b) in enumerate(CASES))}), raw AS (SELECT conv_id || '-' || turn AS case_id, problem, text, text || chr(10) || said AS stdout, stderr FROM conversations JOIN dim ON (conv_id + turn) % 4 = k),
t(problem, priority, title, command) AS (VALUES {", ".join(f"('{p}', {n}, '{t}', '{c}')" for p, n, t, c in diagnosis.TEMPLATES)}),
c AS (SELECT *, {_some_sql("problem = 'crash' AND (contains(stdout, 'SIGSEGV') OR contains(stderr, 'SIGSEGV')) THEN '检测到段错误 (SIGSEGV)'", "problem = 'crash' AND (contains(stdout, 'SIGABRT') OR contains(stderr, 'SIGABRT')) THEN '检测到程序中止 (SIGABRT)'", "problem = 'memory_leak' AND contains(lower(stderr), 'leak') THEN 'Valgrind 检测到内存泄漏'", "problem = 'page_fault' AND (contains(lower(stderr), 'oom') OR contains(lower(stderr), 'out of memory')) THEN '系统内存不足 (OOM)'")} AS symptoms,
 {_some_sql("problem = 'crash' AND contains(stderr, 'not found') THEN '缺少动态库依赖'", "problem = 'crash' AND contains(stderr, 'permission denied') THEN '文件权限不足'", "problem = 'memory_leak' AND contains(stdout, 'definitely lost') AND regexp_extract(stdout, '([0-9]+,?[0-9]*) bytes in', 1) <> '' THEN '确定丢失内存: ' || regexp_extract(stdout, '([0-9]+,?[0-9]*) bytes in', 1) || ' bytes'", "problem = 'page_fault' AND contains(lower(stderr), 'oom') THEN '系统物理内存耗尽，触发 OOM Killer'")} AS causes FROM raw),
fix AS (SELECT case_id, priority, title, command FROM c JOIN t USING (problem) UNION ALL SELECT case_id, 1, '安装缺失依赖', '# 检查具体缺失的库: ' || stderr FROM c WHERE contains(stderr, 'not found'))"""


@query(f"""{CASE_SQL} SELECT case_id, array_to_string(symptoms, '|') AS symptoms, array_to_string(causes, '|') AS causes, array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10))[1:10], lambda x: trim(x)), lambda x: x <> ''), lambda x: '日志错误: ' || substring(x, 1, 100)), '|') AS logs FROM c""")
def q72_symptoms_and_causes(spark, sf):
    c, args = _cases(spark, sf), [F.col(x) for x in ("problem", "stdout", "stderr")]
    joined = lambda x, name: F.array_join(x, "|").alias(name)
    return c.select("case_id", joined(diagnosis.output_symptoms(*args), "symptoms"), joined(diagnosis.output_causes(*args), "causes"), joined(diagnosis.log_symptoms(F.col("text")), "logs"))


@query(f"{CASE_SQL} SELECT case_id, priority, title, command FROM fix")
def q73_repairs(spark, sf):
    return diagnosis.repairs(_cases(spark, sf), "case_id")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 't' || event_id WHEN 1 THEN '优化建议' WHEN 2 THEN 'u' || event_id END AS title, CASE event_id % 4 WHEN 1 THEN 3 ELSE 2 END::INT AS priority FROM events WHERE event_id % 4 <> 3""")
def q74_command_responses(spark, sf):
    text = """CASE event_id % 4 WHEN 0 THEN '```json\n[{"title": "t' || event_id || '", "priority": 2}]\n```' WHEN 1 THEN '{"suggestion": "", "rationale": "r"}' WHEN 2 THEN 'see: {"data": [{"title": "u' || event_id || '", "priority": 2}]} end' ELSE 'no json' END"""
    return responses.suggestions_of(_output(spark, sf, text), "output", "event_id", way="command").select("event_id", "title", "priority")


#: Answers that give nothing else, read by loose titles.
LOOSE_ANSWERS = [
    ("plain answer\n建议1：批处理\n优化: @ §\n建议: 批处理", [("批处理", 0.3), ("@ §", 0.3)]),
    ("[] 优化方案 2: x§", [("x§", 0.3)]),
    ('[{"priority": "high"}]\n建议: 1, 2: y§', [("1, 2: y§", 0.3)]),
    ('[{"title": "z§", "implementation_steps": 5, "self_confidence": "1"}]', [("z§", 1.0)]),
    ("#建议 @\n§", [("建议 @", 0.3)]),
    ("§", []),
]


@query(_answers_sql(LOOSE_ANSWERS, "title, confidence"))
def q75_loose_responses(spark, sf):
    return responses.suggestions_of(_answers(spark, sf, LOOSE_ANSWERS), "output", "event_id", way="loose").select("event_id", "pos", "title", "confidence")


#: Outcomes of debates: how many suggestions, the first place with its code, whether any was accepted.
OUTCOMES = [
    ('{"final_suggestions": [{"title": "t"}], "decision_summary": {"accepted": 2}, "proposals": [{"location": "a.cpp:§", "pseudocode": "@"}, {"location": "nowhere"}]}', [(1, "a.cpp:§", "@", True)]),
    ('```json\n{"final_suggestions": [{}, 3, {"priority": "x"}], "decision_summary": {"accepted": 0}, "proposals": [{"location": ["a:1"]}, {"location": "b.cpp:§"}]}\n```', [(2, "b.cpp:§", "", False)]),
    ("```\nbroken", [(0, None, None, False)]),
    ('{"proposals": §, "final_suggestions": 3, "decision_summary": [1]}', [(0, None, None, False)]),
    ('{"decision_summary": {"accepted": "1"}, "final_suggestions": {"a": 1}}', [(0, None, None, False)]),
    ("[§]", [(0, None, None, False)]),
]


@query("SELECT event_id, n, place, code, consensus FROM (" + _answers_sql(OUTCOMES, "n, place, code, consensus").replace("None", "NULL") + ")")
def q76_debate_outcome(spark, sf):
    d = _answers(spark, sf, OUTCOMES).select("event_id", responses.decided(F.col("output")).alias("d"))
    first = lambda f: F.get(f("d.snippets"), 0)
    return d.select("event_id", F.size("d.suggestions").alias("n"), first(F.map_keys).alias("place"), first(F.map_values).alias("code"), "d.consensus")


@query("SELECT role || conv_id AS model_name, pos::INT AS pos, turn, conv_id % 5 AS priority FROM (SELECT role, conv_id, turn, row_number() OVER (PARTITION BY role, conv_id ORDER BY turn) - 1 AS pos FROM conversations) WHERE conv_id % 7 <> 0")
def q77_collected_results(spark, sf):
    c = S.table(spark, sf, "conversations").groupBy("role", "conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.col("conv_id") % 5).alias("priority")))).alias("suggestions"))
    failed = c.select(F.lit("none").alias("model_name"), F.slice("suggestions", 1, 0).alias("suggestions"), F.lit(None).cast("string").alias("error"))
    r = c.select(F.concat("role", F.col("conv_id").cast("string")).alias("model_name"), "suggestions", F.when(F.col("conv_id") % 7 == 0, "timeout").alias("error"))
    return summaries.collected(summaries.bag_union(r, failed))


@query(f"WITH {SUG}, {SETS} SELECT count(*) FILTER (WHERE final_weight > 0.5e0) AS high_confidence, count(*) FILTER (WHERE NOT final_weight > 0.5e0) AS low_confidence, bool_or(final_weight > 0.5e0) AS valid, count(*) FILTER (WHERE final_weight > 0.5e0)::DOUBLE / count(*) AS consensus_score, count(DISTINCT array_to_string(string_split(lower(title), ' ')[1:2], ' ')) AS topic_groups FROM weights")
def q78_cross_validation(spark, sf):
    return summaries.cross_validation(_weighted(spark, sf))


@query(f"WITH {REC} SELECT count(*) AS total_runs, count(*) FILTER (WHERE error_rate < 0.4e0) AS successful_runs, (sum(actual_qps::DECIMAL(30,12)) FILTER (WHERE error_rate < 0.4e0))::DOUBLE / count(*) FILTER (WHERE error_rate < 0.4e0) AS avg_qps, max(actual_qps) FILTER (WHERE error_rate < 0.4e0) AS best_qps FROM rec")
def q79_suite_summary(spark, sf):
    return summaries.suite_summary(S.records(spark, sf).select(F.col("actual_qps").alias("qps"), (F.col("error_rate") < 0.4).alias("success")))


@query(f"{CHECKS} SELECT count(*) AS n, count(*) FILTER (WHERE is_valid) AS valid, sum(confidence::DECIMAL(30,12))::DOUBLE / count(*) AS avg_confidence, max(confidence) AS highest_confidence, 'high risk|no steps' AS issues FROM w")
def q80_agent_summary(spark, sf):
    s = _checked(spark, sf)
    issues = F.filter(F.array(F.when(F.col("risk_level") == "high", "high risk"), F.when(F.col("n_steps") == 0, "no steps")), lambda x: x.isNotNull())
    v = suggestions.verified(s).join(s.select("seq", issues.alias("issues")), "seq")
    return summaries.agent_summary(v).withColumn("issues", F.array_join("issues", "|"))


def _ranked(spark, sf, k: int = 20):
    s = S.suggestions(spark, sf)
    return suggestions.top_weighted(s, S.model_history(spark, sf), k, of=suggestions.complete(s), least=0.3)


RANKED = f"""WITH {SUG}, {SETS}, r AS (SELECT *, row_number() OVER (ORDER BY CASE risk_level WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, final_weight DESC, priority DESC, seq)::INT AS rank FROM weights WHERE {GOOD} ORDER BY rank LIMIT 20)"""


@query(f"""{RANKED}, h AS (SELECT *, row_number() OVER (ORDER BY priority DESC, rank) AS k FROM r), l AS (SELECT * FROM r WHERE risk_level = 'low' ORDER BY rank LIMIT 1)
SELECT 0::INT AS pos, '优先解决基础瓶颈' AS action, 'high' AS priority, '系统评分较低，建议先从低风险优化入手' AS details UNION ALL SELECT 1, '立即实施 ' || title, 'high', '低风险优化，可快速验证效果' FROM l UNION ALL SELECT (k + 1)::INT, title, 'medium', '优先级 ' || priority || '，预期 ' || expected_gain FROM h WHERE k <= 2""")
def q81_action_items(spark, sf):
    return summaries.action_items(_ranked(spark, sf), 45)


@query(f"WITH {SUG} SELECT seq, priority * CASE risk_level WHEN 'low' THEN 1.2e0 WHEN 'high' THEN 0.7e0 ELSE 1e0 END AS score, row_number() OVER (ORDER BY priority * CASE risk_level WHEN 'low' THEN 1.2e0 WHEN 'high' THEN 0.7e0 ELSE 1e0 END DESC, seq) AS rank FROM sug")
def q82_debate_order(spark, sf):
    return summaries.by_debate_score(S.suggestions(spark, sf)).select("seq", "score", "rank")


@query(f"WITH {SUG} SELECT seq, priority FROM sug ORDER BY priority DESC, seq LIMIT 5")
def q83_priority_cap(spark, sf):
    return summaries.by_priority(S.suggestions(spark, sf)).select("seq", "priority")


@query(f"{CHECKS} SELECT seq, confidence, row_number() OVER (ORDER BY confidence DESC, seq) AS rank FROM w")
def q84_confidence_order(spark, sf):
    return summaries.by_confidence(suggestions.verified(_checked(spark, sf))).select("seq", "confidence", "rank")


@query("SELECT p_partkey AS pos, p_retailprice AS level FROM part WHERE p_retailprice >= 0.8e0 * 1000 ORDER BY p_partkey LIMIT 3")
def q85_next_levels(spark, sf):
    return summaries.next_levels(S.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.col("p_retailprice").alias("level")), 1000)


@query("SELECT n_name, n_nationkey FROM nation WHERE n_name = (SELECT n_name FROM nation WHERE n_nationkey = 7) ORDER BY n_nationkey LIMIT 1")
def q86_point_lookup(spark, sf):
    n = S.table(spark, sf, "nation")
    return summaries.point(n, n.where("n_nationkey = 7").first().n_name, "n_nationkey", "n_name").select("n_name", "n_nationkey")


@query("SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10")
def q87_slow_queries(spark, sf):
    return summaries.slowest(S.table(spark, sf, "events").select("event_id", "value"), 10, "value", "event_id")


@query(f"""{RANKED}, m AS (SELECT trim(unnest(string_split(source_model, ' + '))) AS m FROM r), mm AS (SELECT string_agg(m || '=' || n, '|' ORDER BY m) AS s FROM (SELECT m, count(*) AS n FROM m GROUP BY 1)), rr AS (SELECT string_agg(k || '=' || n, '|' ORDER BY k) AS s FROM (SELECT risk_level AS k, count(*) AS n FROM r GROUP BY 1))
SELECT count(*) AS total, (SELECT s FROM rr) AS by_risk, (SELECT s FROM mm) AS by_model, arg_min(title, rank) AS top_title, arg_min(final_weight, rank) AS top_weight FROM r""")
def q88_suggestion_summary(spark, sf):
    shown = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda x: F.concat(x.key, F.lit("="), x.value.cast("string"))), "|").alias(c)
    return summaries.suggestion_summary(_ranked(spark, sf)).select("total", shown("by_risk"), shown("by_model"), "top_title", "top_weight")


@query(f"WITH {SUG} SELECT (dense_rank() OVER (ORDER BY priority DESC) - 1)::INT AS pos, priority, count(*) OVER (PARTITION BY priority) AS n, row_number() OVER (PARTITION BY priority ORDER BY seq) AS rank, seq, title FROM sug")
def q89_group_by_priority(spark, sf):
    return summaries.grouped_by_priority(S.suggestions(spark, sf))


@query(f"{RANKED} SELECT seq, rank, risk_level FROM (SELECT *, row_number() OVER (PARTITION BY risk_level ORDER BY rank) AS k FROM r) WHERE k <= 2")
def q90_capped_by_risk(spark, sf):
    return summaries.capped_by_risk(_ranked(spark, sf)).select("seq", "rank", "risk_level")


@query("SELECT count(*) AS files, sum(len(string_split(html, chr(10))))::BIGINT AS lines, count(*) AS analyses, sum(page_id)::BIGINT AS hits FROM pages")
def q91_cache_stats(spark, sf):
    p = S.table(spark, sf, "pages")
    files = p.select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    return caches.stats(caches.digests(files), p.select(F.col("page_id").alias("hits")))


@query("SELECT page_id::VARCHAR AS path FROM pages WHERE page_id % 3 = 0 OR page_id % 5 = 0")
def q92_stale_files(spark, sf):
    p = S.table(spark, sf, "pages").select("page_id", F.col("page_id").cast("string").alias("path"), F.col("html").alias("content"))
    seen = caches.digests(p.where("page_id % 3 <> 0"))
    changed = p.withColumn("content", F.when(F.col("page_id") % 5 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return caches.stale(changed.select("path", "content"), seen).select("path")


@query("SELECT doc_id, 'metrics:' || chr(10) || doc_id || CASE WHEN text <> '' THEN chr(10) || chr(10) || 'logs:' || chr(10) || right(text, 5000) || chr(10) || chr(10) || 'source:' || chr(10) || substring(text, 1, 3000) ELSE '' END AS prompt FROM documents")
def q93_prompts(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", reports.prompt(F.col("doc_id").cast("string"), F.col("text"), F.col("text")).alias("prompt"))


@query(f"WITH {SUG} SELECT seq, title, priority FROM sug")
def q94_report_rows(spark, sf):
    d = summaries.as_report_row(S.suggestions(spark, sf))
    got = F.from_json("document", "title string, priority int, base_weight double")
    return d.select("seq", got["title"].alias("title"), got["priority"].alias("priority"))


@query("SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS part FROM documents")
def q95_line_range(spark, sf):
    return S.table(spark, sf, "documents").select("doc_id", parsers.line_range(F.col("text"), F.lit(2), F.lit(4)).alias("part"))


@query()
def q96_regression_report(spark, sf):
    return reports.regression_report(S.snapshots(spark, sf))


@query()
def q97_domain_report(spark, sf):
    s = S.snapshots(spark, sf)
    return reports.domain_report(summaries.latest(s, 1).withColumn("qps", F.col("qps") * 50000).withColumn("target_qps", F.lit(200.0)), _ranked(spark, sf))


@query(f"""{CASE_SQL}, f AS (SELECT case_id, string_agg('- ' || title || ': ' || command, chr(10) ORDER BY priority, title, command) AS fixes FROM fix GROUP BY 1),
v AS (SELECT *, CASE WHEN problem = 'crash' OR contains(stdout, 'SIGSEGV') OR contains(stdout, 'SIGABRT') OR contains(stdout, 'OOM') OR contains(stdout, '段错误') THEN 'critical' WHEN contains(stdout, 'leak') OR contains(stdout, 'deadlock') OR contains(stdout, '内存泄漏') OR contains(stdout, '死锁') THEN 'high' ELSE 'medium' END AS severity FROM c LEFT JOIN f USING (case_id))
SELECT case_id, concat_ws(chr(10) || chr(10), 'problem: ' || problem || chr(10) || 'severity: ' || severity || chr(10) || 'confidence: 75%', CASE WHEN len(symptoms) > 0 THEN 'symptoms:' || chr(10) || '- ' || array_to_string(symptoms, chr(10) || '- ') END,
 CASE WHEN len(causes) > 0 THEN 'causes:' || chr(10) || '- ' || array_to_string(causes, chr(10) || '- ') END, 'suggestions:' || chr(10) || fixes, 'commands:' || chr(10) || '- ldd') AS report FROM v""")
def q98_diagnosis_report(spark, sf):
    c, args = _cases(spark, sf), [F.col(x) for x in ("problem", "stdout", "stderr")]
    fixes = diagnosis.repairs(c, "case_id").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("priority", "title", "command"))).alias("suggestions"))
    d = c.join(fixes, "case_id", "left").select("case_id", "problem", diagnosis.severity(F.col("problem"), F.array("stdout")).alias("severity"), F.lit(0.75).alias("confidence"), diagnosis.output_symptoms(*args).alias("symptoms"), diagnosis.output_causes(*args).alias("causes"), F.array(F.lit("ldd")).alias("commands"), F.coalesce("suggestions", F.array().cast("array<struct<priority: int, title: string, command: string>>")).alias("suggestions"))
    return reports.diagnosis_report(d, "case_id")


@query(f"""WITH {MET} SELECT event_id, md5('{{"avg_latency": ' || avg_latency || ', "error_rate": ' || error_rate || ', "p99_latency": ' || p99_latency || ', "qps": ' || qps || '}}') AS key FROM met""")
def q100_metrics_key(spark, sf):
    return _metrics(spark, sf).select("event_id", caches.metrics_key().alias("key"))


@query("SELECT event_id FROM events WHERE epoch(TIMESTAMP '2024-01-10 12:00:00') - floor(epoch(ts)) < 864000")
def q101_fresh_analyses(spark, sf):
    e = S.table(spark, sf, "events").select("event_id", F.col("ts").alias("cached_at"))
    return caches.fresh(e, F.lit("2024-01-10 12:00:00"), 864000).select("event_id")
