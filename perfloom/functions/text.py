"""Tokens and Jaccard similarity as column expressions; words count letters and digits of all scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The stop words of each similarity.
CONSENSUS_TITLE = ["the", "a", "an", "is", "are", "was", "were", "be", "been", "to", "of", "in", "for", "on", "with", "by", "at", "as", "this", "that", "these", "those", "it", "its", "优化", "性能", "方案", "提高", "改进", "的", "和", "建议", "可以", "进行", "通过", "使用", "需要", "and", "or", "but", "if", "then", "so", "not"]
CONSENSUS_KEYWORDS = ["the", "a", "an", "is", "are", "was", "were", "be", "been", "的", "是", "在", "和", "了", "有", "我", "你", "他", "this", "that", "these", "those", "it", "its", "建议", "可以", "进行", "通过", "使用", "需要"]
DEDUP_TITLE = ["优化", "性能", "方案", "提高", "改进", "建议", "method", "approach", "提升", "如何", "怎么"]
DEDUP_KEYWORDS = ["the", "a", "an", "is", "are", "was", "were", "be", "been", "的", "是", "在", "和", "了", "有", "我", "你", "他", "this", "that", "these", "those", "it", "its", "可以", "进行", "通过", "使用", "需要", "能够", "我们", "这个", "一个", "一些"]


def split_tokens(text: Column, stop: list[str] = ()) -> Column:
    """Distinct lower-cased parts between white space, without stop words."""
    parts = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""))
    return F.array_except(parts, F.array(*map(F.lit, stop))) if stop else parts


def word_tokens(text: Column, stop: list[str] = ()) -> Column:
    """Distinct lower-cased runs of letters, digits and _, without stop words."""
    parts = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    return F.array_except(parts, F.array(*map(F.lit, stop))) if stop else parts


def jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens; 0 where one side has none."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both).cast("double"))
