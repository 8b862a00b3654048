"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def strict_number(text: Column) -> Column:
    """Text to double; anything that is not entirely a finite number becomes NULL.

    The pattern is needed because a Spark cast also takes suffixes such as ``5d``
    and the words NaN and Infinity.
    """
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER), trimmed.try_cast("double"))


def confidence(rating: Column, alpha: float = 40.0) -> Column:
    return F.lit(1.0) + F.lit(float(alpha)) * rating


def json_object(line: Column) -> Column:
    """The line parsed once; NULL unless it is one complete JSON object and nothing else."""
    trimmed = F.trim(line)
    return F.when(trimmed.startswith("{") & trimmed.endswith("}"), F.try_parse_json(line))


def json_text(parsed: Column, field: str) -> Column:
    """A top-level field of a parsed object as text; NULL when absent or null."""
    return F.try_variant_get(parsed, f"$.{field}", "string")


def whole_number(text: Column) -> Column:
    """Text to long, also from ``1.6e12`` or ``7.0``; anything else becomes NULL."""
    return F.coalesce(F.trim(text).try_cast("long"), strict_number(text).try_cast("long"))


def hash_order(seed: int, *parts: Column) -> Column:
    """A reproducible pseudo-random sort key that does not depend on partitioning."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def safe_file_name(name: Column) -> Column:
    return F.replace(name, F.lit(" "), F.lit("_"))


def dot(left: Column, right: Column) -> Column:
    """Inner product of two numeric arrays of equal length, in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def clean_text(text: Column) -> Column:
    """Lower case, everything but letters, digits and marks turned into single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\p{M}]+", " "))


def hybrid_score(rating: Column, sentiment: Column, lowest: Column, highest: Column) -> Column:
    """0.7 rating + 0.3 sentiment, the latter scaled from lowest..highest onto the ratings' 1..5; without a
    spread of sentiments it counts as 3."""
    scaled = F.when(highest > lowest, F.lit(1.0) + F.lit(4.0) * (sentiment - lowest) / (highest - lowest)).otherwise(F.lit(3.0))
    return F.lit(0.7) * rating + F.lit(0.3) * scaled


def recency_confidence(rating: Column, age: Column, tau: float, alpha: float = 40.0) -> Column:
    """Confidence that fades with the age of an interaction, exp(-age / tau), age and tau in the same unit."""
    return confidence(rating, alpha) * F.exp(-age / F.lit(float(tau)))
