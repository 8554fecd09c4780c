"""Suggestions out of model responses, which are JSON more or less."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM = "array<struct<title: string, description: string, pseudocode: string, priority: int, risk_level: string, expected_gain: string, steps: array<string>, confidence: double>>"
FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)
HEADING = re.compile(r"(?:^|\n)#{1,3}\s*(.+)")
#: How titles of suggestions look in answers that aren't JSON.
LOOSE = [re.compile(r"(?:^|\n)#{1,3}\s*(优化|优化方案|建议)[:：]?\s*(.+)", re.M), re.compile(r"()(?:优化|优化方案|建议)\s*\d*[:：]\s*(.+)", re.M)]
#: Risks, what a suggestion has where its answer says nothing, and what stands in for it where only its title could be read (by headings, by loose titles).
RISKS = ("low", "medium", "high")
DEFAULTS = {"title": "未命名建议", "description": "", "pseudocode": "# 无伪代码", "expected_gain": "未知"}
HEADED = {"description": "（解析失败，请参考原文）", "pseudocode": "# 解析失败", "expected_gain": "未知", "implementation_steps": ["请参考完整响应"], "self_confidence": 0.3}
LOOSELY = {"description": "请参考完整响应获取详细分析", "pseudocode": "# 请参考完整响应", "expected_gain": "待评估", "implementation_steps": ["参考完整响应"], "self_confidence": 0.3}
#: Title and gain of a single suggestion that doesn't name them.
SINGLE = {"title": "优化建议", "expected_gain": "性能提升"}


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def _steps(value: object) -> list[str]:
    """A list's entries; a filled string is one step; anything else is none."""
    if isinstance(value, str):
        return [value] if value else []
    return [_text(x) for x in value if x is not None] if isinstance(value, list) else []


def _number(kind: type, value: object, default: float | None) -> float | None:
    """value as int or float, numbers in strings too; default where that can't be."""
    try:
        return kind(value)
    except (ValueError, TypeError, OverflowError):
        return default


def typed(x: object, *, strict: bool = True) -> dict | None:
    """A row out of an item: priority within 1 to 5, confidence within 0 to 1, risk in lower case.

    strict: items whose priority or confidence is no number (null included) or whose risk is an unknown word give None.
    Otherwise such numbers are the defaults and such a risk stays. What isn't an object is None in both cases.
    """
    if not isinstance(x, dict):
        return None
    risk = x.get("risk_level", "medium")
    risk = risk.lower() if isinstance(risk, str) else "medium"
    priority = _number(int, x.get("priority", 3), None if strict else 3)
    confidence = _number(float, x.get("self_confidence", 0.5), None if strict else 0.5)
    if priority is None or confidence is None or strict and risk not in RISKS:
        return None
    row = {k: _text(x.get(k, d)) for k, d in DEFAULTS.items()}
    return row | {"priority": max(1, min(5, priority)), "risk_level": risk, "steps": _steps(x.get("implementation_steps")), "confidence": max(0.0, min(1.0, confidence))}


def _rows(found: object, *, strict: bool = True) -> list[dict]:
    rows = [typed(x, strict=strict) for x in found] if isinstance(found, list) else []
    return [r for r in rows if r is not None]


def _load(text: str) -> tuple[bool, object]:
    """Whether a text is JSON, and its value."""
    try:
        return True, json.loads(text)
    except (ValueError, RecursionError):
        return False, None


def loose(text: str) -> list[dict]:
    """Placeholders for the first three different titles that look like suggestions (whole titles, for both patterns)."""
    titles = [m[-1].strip() for p in LOOSE for m in p.findall(text)]
    return _rows([{"title": t} | LOOSELY for t in list(dict.fromkeys(titles))[:3]])


def items(text: str | None, *, or_loose: bool = False) -> list[dict]:
    """The whole as JSON: a list, or the list under suggestions of an object; else the first fenced block that is JSON: a list, or an object as one suggestion; else placeholders for the first three headings. If nothing came of it and or_loose, loose()."""
    text = text or ""
    good, found = _load(text)
    if good:
        found = found.get("suggestions") if isinstance(found, dict) else found
    else:
        good, found = next((x for x in map(_load, FENCE.findall(text)) if x[0]), (False, None))
        if good:
            found = [found] if isinstance(found, dict) else found
        else:
            found = [{"title": t.strip()} | HEADED for t in HEADING.findall(text)[:3]]
    out = _rows(found)
    return loose(text) if or_loose and not out else out


def command_items(text: str | None) -> list[dict]:
    """Suggestions of a model asked by command: fences off, then an array, an object, or the widest braces or brackets in the text. Odd numbers and risks don't drop an item here."""
    body = (text or "").strip()
    if body.startswith("```"):
        body = re.sub(r"\s*```$", "", re.sub(r"(?m)^```json?\s*", "", body)).strip()
    if not body.startswith(("[", "{")):
        wide = re.search(r"\{[\s\S]*\}|\[[\s\S]*\]", text or "")
        body = wide[0] if wide else "[]"
    data = _load(body)[1]
    if isinstance(data, dict):
        if "optimization_suggestion" in data or "suggestion" in data:
            title = _text(data.get("optimization_suggestion", data.get("suggestion")))
            single = data | {"title": (title or SINGLE["title"])[:100], "description": data.get("rationale", data.get("description", "")), "priority": 3, "risk_level": "medium", "expected_gain": data.get("expected_gain", SINGLE["expected_gain"])}
            return _rows([single], strict=False)
        data = data.get("suggestions", data.get("data"))
    return _rows(data, strict=False)


def cleaned(text: str | None) -> str:
    """JSON out of a fenced answer: its first part that starts like JSON, else its last; other answers as they are."""
    body = (text or "").strip()
    if not body.startswith("```"):
        return body
    parts = [p.strip() for p in body.split("```")]
    parts = [p[4:].strip() if p.startswith("json") else p for p in parts]
    return next((p for p in parts if p.startswith(("{", "["))), parts[-1])


def decision(text: str | None) -> dict:
    """A debate's outcome: final suggestions, code by location (those that name a line), whether any was accepted. What isn't of the kind that is expected counts as missing."""
    data = _load(cleaned(text))[1]
    data = data if isinstance(data, dict) else {}
    proposals, summary = data.get("proposals"), data.get("decision_summary")
    places = [p for p in proposals if isinstance(p, dict) and isinstance(p.get("location"), str) and ":" in p["location"]] if isinstance(proposals, list) else []
    accepted = summary.get("accepted", 0) if isinstance(summary, dict) else 0
    return {"suggestions": _rows(data.get("final_suggestions"), strict=False), "snippets": {p["location"]: _text(p.get("pseudocode", "")) for p in places}, "consensus": isinstance(accepted, int | float) and accepted > 0}


#: The ways to read an answer, by what gave it.
WAYS = {"typed": items, "loose": lambda t: items(t, or_loose=True), "command": command_items}


def parsed(text: Column, way: str = "typed") -> Column:
    """Suggestions of a text column, Arrow batches at a time; way: one of WAYS."""
    read = WAYS[way]

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(read)

    return F.pandas_udf(run, ITEM)(text)


def decided(text: Column) -> Column:
    """decision() of a text column: suggestions, snippets (map), consensus."""

    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([decision(t) for t in texts], columns=["suggestions", "snippets", "consensus"])

    return F.pandas_udf(run, f"suggestions {ITEM}, snippets map<string, string>, consensus boolean")(text)


def suggestions_of(df: DataFrame, text: str, *keep: str, way: str = "typed") -> DataFrame:
    """One row per suggestion, with its place (pos) among those of its answer that could be read."""
    return df.select(*keep, F.posexplode(parsed(F.col(text), way)).alias("pos", "s")).select(*keep, "pos", "s.*")
