"""Rule-based diagnosis: problem type, severity, confidence, cluster health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import first_hit

#: Keywords of each problem type in the order they are tried; memory_ also asks for a leak.
PROBLEMS = [
    (["segfault", "sigsegv", "sigabrt", "段错误", "崩溃", "crash", "abort"], "crash"),
    (["failed to start", "启动失败", "cannot start", "not running", "运行不起来"], "startup_failure"),
    (["page fault", "缺页", "oom", "out of memory", "memory"], "memory_"),
    (["memory leak", "内存泄漏", "leak"], "memory_leak"),
    (["deadlock", "死锁", "hang", "hung", "卡死", "无响应"], "deadlock"),
]
#: Words of severe symptoms, of leaders and of clusters that are ready.
CRITICAL, HIGH = ["段错误", "SIGSEGV", "SIGABRT", "OOM"], ["内存泄漏", "死锁", "leak", "deadlock"]
LEADER = ["I am the leader", "become Leader", "elected as leader", "Leader election", "doHeartBeat()-Leader:", "Leader:{", "发送心跳"]
READY = ["Leader election complete", "election complete", "Leader ready", "start to serve"]


def any_of(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def problem_type(logs: Column, symptoms: Column) -> Column:
    text = F.lower(F.concat(F.coalesce(logs, F.lit("")), F.lit(" "), F.coalesce(symptoms, F.lit(""))))
    kind = first_hit(text, PROBLEMS, "performance")
    return F.when(kind != "memory_", kind).when(any_of(text, ["leak", "泄漏"]), "memory_leak").otherwise("page_fault")


def severity(problem: Column, symptoms: Column) -> Column:
    """symptoms: an array, of which the first that says something decides."""
    worst = F.filter(F.transform(symptoms, lambda s: F.when(any_of(s, CRITICAL), "critical").when(any_of(s, HIGH), "high")), lambda x: x.isNotNull())
    return F.when(problem == "crash", "critical").when(problem == "startup_failure", "high").otherwise(F.coalesce(F.get(worst, 0), F.lit("medium")))


def confidence(outputs: DataFrame, by: str) -> DataFrame:
    """outputs: by, command, stdout, stderr, returncode. More commands, and more that worked, make a diagnosis surer."""
    n = F.count(F.lit(1))
    good = F.count_if((F.col("returncode") == 0) & ((F.coalesce("stdout", F.lit("")) != "") | (F.coalesce("stderr", F.lit("")) != "")))
    base = F.when(n >= 5, 70).when(n >= 3, 60).otherwise(50)
    return outputs.groupBy(by).agg((F.least(base + 5 * good, F.lit(95)) / F.lit(100.0)).alias("confidence"))


def cluster_health(logs: DataFrame, by: str) -> DataFrame:
    """logs: by, node, content. One verdict per cluster, with its reason."""
    c = F.col("content")
    term = F.regexp_extract(c, r"term\{(\d+)\}", 1).try_cast("int")
    a = logs.groupBy(by).agg(F.bool_or(any_of(c, LEADER)).alias("leader"), F.bool_or(any_of(c, READY)).alias("ready"), F.count(term).alias("n_terms"), F.count_distinct(term).alias("kinds"))
    reason = F.when(~F.col("leader"), "no_leader").when(~F.col("ready"), "not_ready").when(F.col("n_terms") < 3, "few_logs").when(F.col("kinds") == 1, "healthy").otherwise("terms_differ")
    return a.select(by, "leader", "ready", F.col("n_terms").cast("long").alias("n_terms"), reason.alias("reason"), (reason == "healthy").alias("healthy"))


#: What to do about each problem: title, command.
TEMPLATES = [
    ("crash", 1, "使用 GDB 调试", "gdb ./binary core"),
    ("crash", 2, "检查动态库依赖", "ldd ./binary"),
    ("memory_leak", 1, "使用 Valgrind 检测", "valgrind --leak-check=full ./binary"),
    ("memory_leak", 2, "使用 AddressSanitizer", "g++ -fsanitize=address -g main.cpp -o main"),
    ("performance", 1, "生成火焰图", "perf record -F 99 -a -g -- sleep 30"),
    ("performance", 2, "检查 CPU 使用", "top -bn1 | head -20"),
]


def listed(*cases: Column) -> Column:
    """The cases that aren't null, as an array."""
    return F.filter(F.array(*cases), lambda x: x.isNotNull())


def output_symptoms(problem: Column, stdout: Column, stderr: Column) -> Column:
    """Symptoms (fixed texts) that a command's output shows for a problem."""
    low = F.lower(stderr)
    return listed(
        F.when((problem == "crash") & (stdout.contains("SIGSEGV") | stderr.contains("SIGSEGV")), "检测到段错误 (SIGSEGV)"),
        F.when((problem == "crash") & (stdout.contains("SIGABRT") | stderr.contains("SIGABRT")), "检测到程序中止 (SIGABRT)"),
        F.when((problem == "memory_leak") & low.contains("leak"), "Valgrind 检测到内存泄漏"),
        F.when((problem == "page_fault") & (low.contains("oom") | low.contains("out of memory")), "系统内存不足 (OOM)"),
    )


def output_causes(problem: Column, stdout: Column, stderr: Column) -> Column:
    """Root causes (fixed texts) that a command's output shows for a problem."""
    lost = F.regexp_extract(stdout, r"(\d+,?\d*) bytes in", 1)
    return listed(
        F.when((problem == "crash") & stderr.contains("not found"), "缺少动态库依赖"),
        F.when((problem == "crash") & stderr.contains("permission denied"), "文件权限不足"),
        F.when((problem == "memory_leak") & stdout.contains("definitely lost") & (lost != ""), F.concat(F.lit("确定丢失内存: "), lost, F.lit(" bytes"))),
        F.when((problem == "page_fault") & F.lower(stderr).contains("oom"), "系统物理内存耗尽，触发 OOM Killer"),
    )


def log_symptoms(logs: Column) -> Column:
    """The first ten lines of an error log that aren't blank, 100 characters of each."""
    first = F.slice(F.split(F.coalesce(logs, F.lit("")), "\n"), 1, 10)
    return F.transform(F.filter(F.transform(first, lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.concat(F.lit("日志错误: "), F.substring(x, 1, 100)))


def repairs(outputs: DataFrame, by: str) -> DataFrame:
    """by, priority, title, command: the templates of the problem, then one for each output that misses something.

    outputs: by, problem (one per by), seq, stderr.
    """
    spark = outputs.sparkSession
    dim = spark.createDataFrame(TEMPLATES, "problem string, priority int, title string, command string")
    known = outputs.groupBy(by).agg(F.first("problem").alias("problem")).join(F.broadcast(dim), "problem").select(by, "priority", "title", "command")
    missing = outputs.where(F.col("stderr").contains("not found")).select(by, F.lit(1).alias("priority"), F.lit("安装缺失依赖").alias("title"), F.concat(F.lit("# 检查具体缺失的库: "), "stderr").alias("command"))
    return known.union(missing)
