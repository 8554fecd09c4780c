"""Metrics out of tool output, as column expressions over a text column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBER = r"([\d.]+)"
#: Patterns of the standard benchmark output, and the cascades tried in order.
STANDARD = {"qps": [r"(?i)QPS[:\s]+([\d.]+)"], "avg_latency": [r"(?i)(?:Avg|Average)\s*Latency[:\s]+([\d.]+)\s*(?:ms|millisec)"], "p50_latency": [r"(?i)P50\s*Latency[:\s]+([\d.]+)\s*(?:ms|millisec)"], "p99_latency": [r"(?i)P99\s*Latency[:\s]+([\d.]+)\s*(?:ms|millisec)"], "error_rate": [r"(?i)Error\s*Rate[:\s]+([\d.]+)%?"]}
CASCADE = {
    "qps": [r"(?i)QPS[:\s=]+([\d.]+)", r"(?i)([\d.]+)\s+ops/s", r"(?i)Throughput[:\s]+([\d.]+)"],
    "avg_latency": [r"(?i)(?:平均延迟|平均|Avg)[：:\s]+([\d.]+)\s*(?:ms|millisec)?", r"(?i)(?:Average|Avg)\s*Latency[:\s]+([\d.]+)", r"(?i)Latency[:\s]+([\d.]+)\s*ms"],
    "p50_latency": [r"(?i)P50[^:]*[:\s]+([\d.]+)", r"(?i)P50\s*Latency[:\s]+([\d.]+)", r"(?i)Median\s+latency[:\s]+([\d.]+)"],
    "p99_latency": [r"(?i)P99[^:]*[:\s]+([\d.]+)", r"(?i)P99\s*Latency[:\s]+([\d.]+)", r"(?i)99%\s*([\d.]+)"],
    "p95_latency": [r"(?i)P95[^:]*[:\s]+([\d.]+)"],
    "error_rate": [r"(?i)(?:Error|Fail)[：:\s]+([\d.]+)", r"(?i)错误率[:\s]+([\d.]+)"],
}
#: The formats of code locations, of redis-benchmark, sysbench, perf, gdb, node logs and Valgrind.
SYSBENCH_RATE, SYSBENCH_LATENCY = r"requests:\s+(\d+)\s+in\s+([\d.]+)s", r"avg:\s+([\d.]+)\s+min:"
HOTSPOT, FRAME = r"^\s*([\d.]+)%\s+(.+)", r"^#(\d+)\s+(0x[0-9a-f]+)\s+in\s+(\S+)\s+\(\)"
SIGNALS = [r"Program terminated with signal (\w+)", r"Signal:\s*(\w+)"]
NODE = {"term": r"term\{(\d+)\}", "last_log_index": r"lastLogIndex[:\s=]+(\d+)", "commit_index": r"commitIndex[:\s=]+(\d+)"}
NODE_ERRORS = ["ERROR", "FATAL", "WRONG"]
REDIS_LATENCY, REDIS_P99 = r"(?i)(?:Latency|Avg)\s*[:\-]?\s*([\d.]+)\s*(?:ms|us|microseconds)?", r"(?i)99th\s+percentile\s*[:\-]?\s*([\d.]+)"
#: What a signal means and what to do, in the order of the report.
ADVICE = {"SIGSEGV": ("段错误 (SIGSEGV)", "检查空指针解引用或访问非法内存地址"), "SIGABRT": ("程序中止 (SIGABRT)", "可能是 assert 失败或 abort() 调用"), "SIGFPE": ("浮点异常 (SIGFPE)", "检查除零操作")}
LOCATIONS = [(r"([^\s:]+\.(?:cpp|h|cc|cxx)):\s*(\d+)", 1), (r"([^\s:]+)\s+line\s+(\d+)", 1), (r"([^\s:]+)\s+第\s+(\d+)\s+行", 1)]


def number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("double")


def first_number(text: Column, patterns: list[str]) -> Column:
    return F.coalesce(*(number(text, p) for p in patterns))


def _rate(x: Column) -> Column:
    return F.when(x > 1, x / 100).otherwise(x)


def standard(text: Column) -> dict[str, Column]:
    return {k: (_rate(first_number(text, p)) if k == "error_rate" else first_number(text, p)) for k, p in STANDARD.items()}


def cascade(text: Column) -> dict[str, Column]:
    return {k: (_rate(first_number(text, p)) if k == "error_rate" else first_number(text, p)) for k, p in CASCADE.items()}


def bench_metrics(df: DataFrame, text: str, how: str = "combined") -> DataFrame:
    """df with qps, avg_latency, p50_latency, p99_latency and error_rate, 0 where missing.

    combined: the cascades, and the standard patterns only where no cascade found anything (p95 counts as found, but no
    column shows it).
    """
    std, cas = standard(F.col(text)), cascade(F.col(text))
    none = F.coalesce(*cas.values()).isNull()
    pick = {"standard": std, "cascade": {k: cas[k] for k in std}, "combined": {k: F.when(none, std[k]).otherwise(cas[k]) for k in std}}[how]
    return df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in pick.items()})


def redis_metrics(df: DataFrame, text: str) -> DataFrame:
    """qps of SET, else of GET; latency in ms; p50 and p99 from it where none is given."""
    t = F.col(text)
    rate = lambda op: F.try_divide(number(t, rf"(?i){op}.*?(\d+\.?\d*)\s+requests\s+in\s+(\d+\.?\d*)\s+s", 1), number(t, rf"(?i){op}.*?(\d+\.?\d*)\s+requests\s+in\s+(\d+\.?\d*)\s+s", 2))
    pattern = REDIS_LATENCY
    small = F.lower(F.regexp_extract(t, pattern, 0)).rlike("us|micro")
    avg = F.coalesce(F.when(small, number(t, pattern) / 1000).otherwise(number(t, pattern)), F.lit(0.0))
    p99 = F.coalesce(number(t, REDIS_P99), avg * 2)
    first = F.coalesce(rate("SET"), F.lit(0.0))
    return df.withColumns({"qps": F.when(first == 0, F.coalesce(rate("GET"), F.lit(0.0))).otherwise(first), "avg_latency": avg, "p50_latency": avg * 0.8, "p99_latency": p99})


#: Metrics of a system that couldn't be asked.
UNREACHABLE = {"qps": 0.0, "avg_latency": 0.0, "p50_latency": 0.0, "p99_latency": 0.0, "error_rate": 1.0}


def info_value(text: Column, name: str) -> Column:
    """What stands behind name: in the lines of an INFO text, the last one of several; null if it isn't there."""
    found = F.regexp_extract_all(text, F.lit(rf"(?m)^{name}:(.*?)\s*$"), F.lit(1))
    return F.element_at(found, F.when(F.size(found) > 0, -1).otherwise(F.lit(None).cast("int")))


def redis_info_metrics(df: DataFrame, text: str) -> DataFrame:
    """df with qps, avg_latency (ms), p50_latency, p99_latency and error_rate out of redis' INFO; missing values are 0.

    p50 and p99 are 0.8 times and twice the average. A rate or latency that is no number gives the metrics of an
    unreachable system; counts that are no whole numbers give an error rate of 0.
    """
    t = F.col(text)
    rate, latency = (F.coalesce(info_value(t, n), F.lit("0")).try_cast("double") for n in ("instantaneous_ops_per_sec", "avg_cmd_latency_us"))
    total, rejected = (F.coalesce(info_value(t, n), F.lit("0")).try_cast("long") for n in ("total_commands_processed", "rejected_commands"))
    avg = latency / 1000
    found = {"qps": rate, "avg_latency": avg, "p50_latency": avg * 0.8, "p99_latency": avg * 2, "error_rate": F.coalesce(F.when(total > 0, rejected / total), F.lit(0.0))}
    good = rate.isNotNull() & latency.isNotNull()
    return df.withColumns({k: F.when(good, v).otherwise(F.lit(UNREACHABLE[k])) for k, v in found.items()})


def mysql_metrics(df: DataFrame, text: str, by: str, times: DataFrame) -> DataFrame:
    """by, qps, avg_latency, p50_latency, p99_latency and error_rate out of SHOW GLOBAL STATUS (one text a by) and the times of a slow log (by, seconds).

    The average is taken for 1 ms, p50 for 0.9 ms; p99 is the nearest rank of the slow log's times, 10 ms without any. Counts
    that are missing, or nothing to divide by, give 0.
    """
    t = F.col(text)
    count = lambda name: F.regexp_extract(t, rf"{name}\s+(\d+)", 1).try_cast("long")
    ratio = lambda a, b: F.coalesce(F.when(count(b) > 0, count(a) / count(b)), F.lit(0.0))
    status = df.select(by, ratio("Questions", "Uptime").alias("qps"), F.lit(1.0).alias("avg_latency"), F.lit(0.9).alias("p50_latency"), ratio("Aborted_connects", "Connections").alias("error_rate"))
    return status.join(p99_or_default(times, df.select(by), by).withColumnRenamed("p99_ms", "p99_latency"), by).select(by, *UNREACHABLE)


def location(df: DataFrame, text: str) -> DataFrame:
    """df with file, line_start and line_end (line_start + 5) of the first format that fits."""
    t = F.col(text)
    file = F.coalesce(*(F.when(t.rlike(p), F.regexp_extract(t, p, 1)) for p, _ in LOCATIONS))
    line = F.coalesce(*(F.when(t.rlike(p), F.regexp_extract(t, p, 2).try_cast("int")) for p, _ in LOCATIONS))
    return df.withColumns({"file": file, "line_start": F.coalesce(line, F.lit(0)), "line_end": F.coalesce(line + 5, F.lit(0))})


def lines_of(df: DataFrame, text: str) -> DataFrame:
    """One row per line: df's columns, pos from 0, line."""
    return df.select(*(c for c in df.columns if c != text), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def hotspots(df: DataFrame, text: str, by: str, k: int = 5) -> DataFrame:
    """The first k lines `12.5% name` over 0.5 % among the first 30 of a report; priority 5 for the first, then less."""
    from pyspark.sql import Window

    rows = lines_of(df.select(by, text), text).where("pos < 30")
    rows = rows.select(by, "pos", number(F.col("line"), HOTSPOT).alias("percent"), F.regexp_extract("line", HOTSPOT, 2).alias("name")).where("percent > 0.5")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("pos"))).where(F.col("r") <= k)
    return rows.select(by, "percent", "name", (6 - F.col("r")).alias("priority"))


def gdb_frames(df: DataFrame, text: str, by: str) -> DataFrame:
    """Frames `#3 0x1f in name ()` of a backtrace."""
    rows = lines_of(df.select(by, text), text).where(F.col("line").rlike(FRAME))
    return rows.select(by, F.regexp_extract("line", FRAME, 1).cast("int").alias("frame"), F.regexp_extract("line", FRAME, 2).alias("address"), F.regexp_extract("line", FRAME, 3).alias("function"))


def section(text: Column, start: str, end: str) -> Column:
    """What stands between a start mark and the next end mark (or the end), trimmed; empty without the start mark."""
    after = F.substr(text, F.instr(text, F.lit(start)) + len(start))
    part = F.when(F.instr(after, F.lit(end)) > 0, F.substring_index(after, end, 1)).otherwise(after)
    return F.when(F.instr(text, F.lit(start)) > 0, F.trim(part, F.lit(" \t\r\n"))).otherwise("")


def gdb_report(df: DataFrame, text: str, by: str) -> DataFrame:
    """by, signal (how the program ended, else the one named), frames, threads, top_function, advice (titles)."""
    t = F.col(text)
    found = [F.regexp_extract(t, p, 1) for p in SIGNALS]
    signal = F.coalesce(*(F.when(x != "", x) for x in found))
    lines = F.split(section(t, "=== BACKTRACE ===", "=== "), "\n")
    frames = F.filter(lines, lambda x: x.rlike(FRAME))
    threads = F.filter(F.transform(F.split(section(t, "=== THREAD INFO ===", "==="), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    top = F.when(F.size(frames) > 0, F.regexp_extract(F.get(frames, 0), FRAME, 3))
    meant = F.coalesce(*(F.when(signal == k, v[0]) for k, v in ADVICE.items()))
    advice = F.filter(F.array(meant, F.when(top.isNotNull(), "查看崩溃函数")), lambda x: x.isNotNull())
    return df.select(by, signal.alias("signal"), F.size(frames).alias("frames"), F.size(threads).alias("threads"), top.alias("top_function"), advice.alias("advice"))


def sysbench_metrics(df: DataFrame, text: str) -> DataFrame:
    """The standard metrics; where none is found, qps and avg_latency of sysbench's summary."""
    std, t = standard(F.col(text)), F.col(text)
    none = F.coalesce(*std.values()).isNull()
    own = {"qps": F.try_divide(number(t, SYSBENCH_RATE, 1), number(t, SYSBENCH_RATE, 2)), "avg_latency": number(t, SYSBENCH_LATENCY)}
    return df.withColumns({k: F.coalesce(F.when(none, own.get(k)).otherwise(v) if k in own else v, F.lit(0.0)) for k, v in std.items()})


def slow_times(df: DataFrame, text: str, by: str) -> DataFrame:
    """by, seconds: every Query_time of a slow log."""
    return df.select(by, F.explode(F.regexp_extract_all(text, F.lit(r"Query_time:\s+([\d.]+)"), F.lit(1))).alias("seconds")).select(by, F.col("seconds").try_cast("double").alias("seconds"))


def p99_or_default(times: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """by, p99_ms for every key: nearest rank of its times; 10 without any."""
    from .history import nearest_rank

    return keys.join(nearest_rank(times, by, "seconds", {"p": 0.99}), by, "left").select(by, F.coalesce(F.col("p") * 1000, F.lit(10.0)).alias("p99_ms"))


def node_status(logs: DataFrame, by: str, text: str = "content") -> DataFrame:
    """by, term, last_log_index, commit_index, and errors: of a log's last 50 lines those that speak of errors, 100 characters of each."""
    t = F.col(text)
    last = F.split(t, "\n")
    last = F.slice(last, F.greatest(F.size(last) - 49, F.lit(1)), 50)
    hit = lambda x: x.contains(NODE_ERRORS[0]) | x.contains(NODE_ERRORS[1]) | x.contains(NODE_ERRORS[2])
    errors = F.transform(F.filter(last, hit), lambda x: F.substring(F.trim(x), 1, 100))
    return logs.select(by, *(F.regexp_extract(t, p, 1).try_cast("long").alias(k) for k, p in NODE.items()), errors.alias("errors"))


def cpu_lines(df: DataFrame, text: str, by: str, process: str) -> DataFrame:
    """by, snapshot (the last line with Cpu(s)) and processes (other lines that name the process) of top's output."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    cpu = F.filter(lines, lambda x: x.contains("Cpu(s)"))
    return df.select(by, F.element_at(cpu, F.when(F.size(cpu) > 0, -1).otherwise(F.lit(None).cast("int"))).alias("snapshot"), F.filter(lines, lambda x: ~x.contains("Cpu(s)") & x.contains(process)).alias("processes"))


def missing_libraries(text: Column) -> Column:
    """Lines of ldd's output that tell of a library that isn't there."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x.contains("not found"))


def available_memory(text: Column) -> Column:
    """The seventh field of the line Mem: in the output of free -h, or null."""
    line = F.get(F.filter(F.split(text, "\n"), lambda x: x.startswith("Mem:")), 0)
    return F.get(F.split(line, r"\s+"), 6)


def tail(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each by."""
    from pyspark.sql import Window

    return df.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("_r") <= n).drop("_r")


def error_lines(df: DataFrame, by: str, line: str, order: str, window: int = 500, n: int = 50) -> DataFrame:
    """Of each file's last lines those that speak of errors, and of those the last n."""
    return tail(tail(df, by, order, window).where(F.upper(line).rlike("ERROR|FATAL|FAIL|WRONG")), by, order, n)


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1), clamped to those there are."""
    lines = F.split(text, "\n")
    first, last = F.greatest(start, F.lit(1)), F.least(end, F.size(lines))
    return F.array_join(F.slice(lines, first, F.greatest(last - first + 1, F.lit(0))), "\n")


def snippet(df: DataFrame, text: str, at: Column, around: int = 3) -> DataFrame:
    """The lines around a line (from 1), numbered, the line itself marked."""
    rows = F.transform(F.split(F.col(text), "\n"), lambda line, i: F.struct((i + 1).alias("i"), line.alias("line")))
    near = F.filter(rows, lambda r: (r.i >= at - around) & (r.i <= at + around))
    shown = F.transform(near, lambda r: F.concat(F.when(r.i == at, ">>> ").otherwise("    "), F.lpad(r.i.cast("string"), 4, " "), F.lit(": "), r.line))
    return df.withColumn("snippet", F.array_join(shown, "\n"))
