"""Scalar rules on metrics, risks and model names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_hit(text: Column, rules: list[tuple[list[str], object]], default: object) -> Column:
    """The value of the first rule of which some keyword lies in text; keywords are taken as they are."""
    out = F.lit(default)
    for words, value in reversed(rules):
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = F.when(hit, F.lit(value)).otherwise(out)
    return out


def gap_to_target(qps: Column, target: Column) -> Column:
    """Per cent that is missing to the target; 0 without a positive target."""
    return F.when(target <= 0, F.lit(0.0)).otherwise((target - qps) / target * 100)


def is_healthy(error_rate: Column) -> Column:
    return error_rate < 0.01


def succeeded(actual: Column, target: Column, error_rate: Column) -> Column:
    return (actual >= target * 0.9) & (error_rate < 0.05)


def achievable(qps: Column, target: Column) -> Column:
    return qps >= target * 0.9


def threads_for(qps: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(16), (qps / 90).cast("int") + 1))


def risk_factor(risk: Column) -> Column:
    return F.when(risk == "low", 1.1).when(risk == "medium", 1.0).otherwise(0.8)


def consensus_factor(similar: Column) -> Column:
    return F.when(similar <= 0, 0.8).when(similar == 1, 0.9).when(similar == 2, 1.0).when(similar <= 4, 1.2).otherwise(1.5)


def accuracy_factor(adopted: Column, total: Column) -> Column:
    """Half, plus the adoption rate shrunk by one success in two."""
    return (F.coalesce(adopted, F.lit(0)) + 1.0) / (F.coalesce(total, F.lit(0)) + 2.0) + 0.5


#: Name parts and the weight of a model without one of its own.
OPENAI_LIKE = [(["gpt-4", "claude", "deepseek-chat", "qwen-plus"], 1.2), (["gpt-3.5", "deepseek-coder", "qwen-turbo"], 0.9)]
CLAUDE_LIKE = [(["opus"], 1.5), (["sonnet"], 1.3), (["haiku"], 0.9)]


def default_weight(model: Column, *, claude_like: bool = False) -> Column:
    return first_hit(F.lower(model), CLAUDE_LIKE, 1.2) if claude_like else first_hit(F.lower(model), OPENAI_LIKE, 0.7)


def priority_or_default(priority: Column) -> Column:
    """Typed rows: out of 1 to 5 becomes 3."""
    return F.when(priority.between(1, 5), priority).otherwise(3)


def priority_clamped(priority: Column) -> Column:
    """JSON rows: out of 1 to 5 goes to the nearer end."""
    return F.least(F.lit(5), F.greatest(F.lit(1), priority))


def confidence_or_default(c: Column) -> Column:
    return F.when(c.between(0, 1), c).otherwise(0.5)


def confidence_clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def score_card(qps: Column, avg: Column, p99: Column, err: Column) -> Column:
    """Points out of 100."""
    a = F.when(qps >= 300, 30).when(qps >= 200, 20).when(qps >= 100, 10).otherwise(0)
    b = F.when(avg <= 5, 25).when(avg <= 10, 15).otherwise(0)
    c = F.when(p99 <= 20, 25).when(p99 <= 50, 15).otherwise(0)
    d = F.when(err < 0.01, 20).when(err < 0.05, 10).otherwise(0)
    return a + b + c + d


def grade(score: Column) -> Column:
    return F.when(score >= 80, "A").when(score >= 60, "B").when(score >= 40, "C").otherwise("D")


def impact(priority: Column, risk: Column, valid: Column) -> Column:
    """What to expect of a suggestion: fixed texts by location, priority and risk."""
    high = priority >= 4
    return (
        F.when(~valid, "无法估算（代码位置无效）")
        .when(high & (risk == "low"), "预期收益高，风险低，建议优先实施")
        .when(high & (risk == "medium"), "预期收益高，需谨慎实施，建议先在测试环境验证")
        .when(high & (risk == "high"), "预期收益高，但风险也高，建议最后实施")
        .when(priority >= 3, "预期收益中等，可以考虑实施")
        .otherwise("优先级较低，可以延后处理")
    )


def provider(base_url: Column, model: Column) -> Column:
    """The provider that a base URL or a model name tells, the first that fits."""
    url, name = F.lower(base_url), F.lower(model)
    return F.when(url.contains("deepseek"), "deepseek").when(url.contains("dashscope") | name.contains("qwen"), "dashscope").when(url.contains("openai"), "openai").otherwise("openai-compatible")


def ratio(part: Column, whole: Column) -> Column:
    """part over whole as a double; 0 without a positive whole."""
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def strengths(qps: Column, avg: Column, p99: Column, err: Column) -> Column:
    """Names of the metrics that are good."""
    return F.filter(F.array(F.when(qps >= 350, "qps"), F.when(avg <= 5, "avg_latency"), F.when(p99 <= 15, "p99_latency"), F.when(err < 0.01, "error_rate")), lambda x: x.isNotNull())


def bottlenecks(qps: Column, avg: Column, p99: Column, err: Column) -> Column:
    """Names of the metrics that are bad."""
    return F.filter(F.array(F.when(qps < 200, "qps"), F.when(avg > 10, "avg_latency"), F.when(p99 > 50, "p99_latency"), F.when(err > 0.05, "error_rate")), lambda x: x.isNotNull())
