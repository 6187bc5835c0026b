"""Risk buckets, trust scores and badges (operators C6-C8, C12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import rules


def risk_level(points: Column) -> Column:
    """Bucket of risk points (operator C7)."""
    return F.when(points >= rules.RED_POINTS, "red").when(points >= rules.YELLOW_POINTS, "yellow").otherwise("green")


def trust_score(points: Column) -> Column:
    """100 minus the points, rounded half to even and kept within 0..100 (operator C6)."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.lit(100.0) - points, 0).cast("int")))


def trust_badge(score: Column, risk: Column) -> Column:
    """``{label, emoji, color, message}`` of a score and bucket (operator C8)."""
    result = None
    for level, top, label, emoji, color, message in rules.BADGES:
        badge = F.struct(
            F.lit(label).alias("label"), F.lit(emoji).alias("emoji"),
            F.lit(color).alias("color"), F.lit(message).alias("message"),
        )
        if level is None:
            return result.otherwise(badge)
        test = (risk == level) | (score <= top)
        result = F.when(test, badge) if result is None else result.when(test, badge)
    return result


def readme_badge(
    repo_name: Column,
    score: Column,
    badge_base: str = "https://img.shields.io/badge/Risk%20Scan-",
    report_base: str = "https://reports.example/report/",
    alt: str = "Risk Scan",
) -> Column:
    """``{badge_image_url, badge_markdown, badge_html}`` for a repository page (operator C12)."""
    color = None
    for lowest, name in rules.README_BADGE_COLORS:
        if lowest is None:
            color = color.otherwise(name)
        else:
            color = F.when(score >= lowest, name) if color is None else color.when(score >= lowest, name)
    image = F.concat(F.lit(badge_base), score.cast("string"), F.lit("%2F100-"), color)
    link = F.concat(F.lit(report_base), repo_name)
    return F.struct(
        image.alias("badge_image_url"),
        F.concat(F.lit(f"[![{alt}]("), image, F.lit(")]("), link, F.lit(")")).alias("badge_markdown"),
        F.concat(F.lit("<a href='"), link, F.lit("'><img src='"), image, F.lit("'/></a>")).alias("badge_html"),
    )
