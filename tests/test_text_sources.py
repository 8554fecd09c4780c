import json

from pyspark.sql import functions as F

from perfloom.operators import diagnosis, parsers, responses
from perfloom.sources import readers, sinks


def one(spark, text):
    return spark.createDataFrame([(text,)], "t string")


def test_bench_output(spark):
    r = parsers.bench_metrics(one(spark, "QPS: 265.678 ops/s\n平均延迟: 3.07557 ms\np99 延迟: 8.767 ms"), "t").first()
    assert (r.qps, r.avg_latency, r.p99_latency, r.error_rate) == (265.678, 3.07557, 8.767, 0.0)
    lost = parsers.bench_metrics(one(spark, "QPS: 1\nError Rate: 2%"), "t").first()
    kept = parsers.bench_metrics(one(spark, "QPS: 1\nError Rate: 2%"), "t", "standard").first()
    assert lost.error_rate == 0.0 and kept.error_rate == 0.02
    assert parsers.bench_metrics(one(spark, "Error Rate: 2%"), "t").first().error_rate == 0.02


def test_redis_output(spark):
    r = parsers.redis_metrics(one(spark, "SET: 1000 requests in 2.0 s\nLatency: 500 us"), "t").first()
    assert (r.qps, r.avg_latency, r.p99_latency) == (500.0, 0.5, 1.0)


def test_locations(spark):
    df = spark.createDataFrame([("Raft/Raft.cpp:156",), ("Raft/Raft.cpp line 7",), ("Raft/Raft.cpp 第 9 行",), ("nowhere",), (None,)], "t string")
    got = [(r.file, r.line_start, r.line_end) for r in parsers.location(df, "t").collect()]
    assert got == [("Raft/Raft.cpp", 156, 161), ("Raft/Raft.cpp", 7, 12), ("Raft/Raft.cpp", 9, 14), (None, 0, 0), (None, 0, 0)]


def test_problem_types(spark):
    texts = ["SIGSEGV at 3", "cannot start", "OOM", "memory usage leak", "handle leak", "hung", "fine", None]
    want = ["crash", "startup_failure", "page_fault", "memory_leak", "memory_leak", "deadlock", "performance", "performance"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.p for r in df.select(diagnosis.problem_type(F.col("t"), F.lit(None)).alias("p")).collect()] == want
    s = df.limit(1).select(diagnosis.severity(F.lit("performance"), F.array(F.lit("x"), F.lit("leak"), F.lit("OOM"))).alias("s"))
    assert s.first().s == "high"


def test_responses(spark):
    item = {"title": "a", "description": "d", "priority": 9, "risk_level": "low", "self_confidence": 7}
    texts = [json.dumps([item, item]), "x\n```json\n" + json.dumps(item) + "\n```", json.dumps({"other": 1}), "# First\ntext\n## Second", "junk", None, json.dumps([item | {"risk_level": "odd"}])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = responses.suggestions_of(df, "t", "i").collect()
    count = lambda i: sum(r.i == i for r in got)
    assert [count(i) for i in range(7)] == [2, 1, 0, 2, 0, 0, 0]
    assert {(r.priority, r.confidence) for r in got if r.i < 2} == {(5, 1.0)}


def test_odd_answers_are_read_or_dropped_one_by_one():
    one = lambda **x: responses.items(json.dumps([x]))
    assert one() == [{"title": "未命名建议", "description": "", "pseudocode": "# 无伪代码", "expected_gain": "未知", "priority": 3, "risk_level": "medium", "steps": [], "confidence": 0.5}]
    assert [(r["priority"], r["confidence"]) for r in one(priority="4", self_confidence="0.9")] == [(4, 0.9)]
    assert one(priority=4.7)[0]["priority"] == 4 and one(priority=True)[0]["priority"] == 1 and one(priority=" -2 ")[0]["priority"] == 1
    assert one(priority="4.5") == one(priority=None) == one(self_confidence="x") == one(self_confidence=None) == one(risk_level=" low ") == one(priority=[1]) == one(priority=1e999) == []
    assert one(risk_level="HIGH")[0]["risk_level"] == "high" and one(risk_level=3)[0]["risk_level"] == "medium"
    assert one(confidence=0.9)[0]["confidence"] == 0.5  # no key of an item
    assert one(implementation_steps="do it")[0]["steps"] == ["do it"] and one(implementation_steps=5)[0]["steps"] == [] and one(implementation_steps=["a", None, 2])[0]["steps"] == ["a", "2"]
    assert one(title=None)[0]["title"] is None and one(title={"a": "é"})[0]["title"] == '{"a": "é"}'
    assert responses.items('[3, null, "x", [1], {"title": "t"}]')[0]["title"] == "t"
    assert responses.items("5") == responses.items("null") == responses.items('{"suggestions": 5}') == responses.items('{"suggestions": {"title": "t"}}') == []
    assert [r["title"] for r in responses.items('```json\n{"suggestions": [{"title": "in"}]}\n```')] == ["未命名建议"]  # a fenced object is a suggestion
    assert [r["title"] for r in responses.items('```\n{broken\n``` then ```json\n[{"title": "t"}]\n```')] == ["t"]
    assert responses.items("```\n5\n``` ```json\n[{}]\n```") == []  # the first block that is JSON decides
    head = responses.items("##Title\n### \n next\n#third\n#fourth")
    assert [r["title"] for r in head] == ["Title", "next", "third"] and head[0]["pseudocode"] == "# 解析失败" and head[0]["description"] and head[0]["confidence"] == 0.3
    assert responses.items("[" * 100_000) == []
    assert [r["priority"] for r in responses.command_items('[{"priority": "x", "risk_level": "odd"}, {"priority": 2}, 7]')] == [3, 2]
    assert responses.command_items('{"suggestion": {"a": 1}}')[0]["title"] == '{"a": 1}' and responses.command_items('{"suggestion": ""}')[0]["title"] == "优化建议"
    nothing = {"suggestions": [], "snippets": {}, "consensus": False}
    assert responses.decision('{"proposals": 5, "final_suggestions": 3, "decision_summary": [1]}') == nothing
    assert responses.decision('{"proposals": [{"location": ["a:1"]}, 3, {"location": "f"}], "final_suggestions": {"a": 1}, "decision_summary": {"accepted": "1"}}') == nothing
    assert responses.decision('{"proposals": [{"location": "a:1", "pseudocode": null}], "decision_summary": {"accepted": 0.5}}')["snippets"] == {"a:1": None}


def test_readers_and_sinks(spark, tmp_path):
    (tmp_path / "a.log").write_text("one\ntwo ERROR\nthree\n")
    lines = readers.log_lines(spark, str(tmp_path / "*.log"))
    assert [(r.pos, r.line) for r in lines.orderBy("pos").collect()] == [(0, "one"), (4, "two ERROR"), (14, "three")]
    assert parsers.error_lines(lines, "file", "line", "pos").count() == 1
    (tmp_path / "m.json").write_text(json.dumps({"m": {"adopted": 2, "total": 3}}))
    assert readers.model_history(spark, str(tmp_path / "m.json")).first().adopted == 2
    assert readers.suggestion_file is not None and readers.resolve({"a": ["${NOT_SET_ANYWHERE}", "x${Y}"]}) == {"a": ["", "x${Y}"]}
    info = one(spark, "# Server\r\nversion:7.2\r\nurl:a:b\r\n").select(readers.key_values(F.col("t")).alias("m")).first().m
    assert info == {"version": "7.2", "url": "a:b"}
    shapes = spark.createDataFrame([('[{"title": "a"}]',), ('{"suggestions": [{"title": "b"}]}',), ('{"title": "c"}',)], "t string")
    assert [r.s[0].title for r in shapes.select(readers.suggestion_file(F.col("t")).alias("s")).collect()] == ["a", "b", "c"]
    rec = spark.createDataFrame([("r", 10.0, 9.5, 1.0, 0.0, 2)], "system string, target_qps double, actual_qps double, avg_latency double, error_rate double, threads int").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    sinks.export_csv(rec, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().success == "true"
    sinks.export_json(rec, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).first().actual_qps == 9.5
    ev = spark.createDataFrame([("m", i, i % 2 == 0) for i in range(5)], "source_model string, at int, adopted boolean")
    r = sinks.latest_adoptions(ev, 2).first()
    assert (r.total, r.adopted, [d.at for d in r.details]) == (5, 3, [3, 4])


def test_snippet(spark):
    r = parsers.snippet(one(spark, "a\nb\nc\nd\ne\nf"), "t", F.lit(2), 1).first().snippet
    assert r == "       1: a\n>>>    2: b\n       3: c"
