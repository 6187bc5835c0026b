"""File kinds, path weights and repository addresses (operators S2, S3, C9-C11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions import patterns


def is_code_file(path: Column, extensions: Sequence[str] = tuple(rules.CODE_EXTENSIONS)) -> Column:
    names = "|".join(e.lstrip(".") for e in extensions)
    return F.lower(path).rlike(rf"\.(?:{names})\z")


def is_manifest(path: Column) -> Column:
    names = "|".join(patterns.literal(name) for name in rules.MANIFEST_ECOSYSTEMS)
    return F.lower(path).rlike(rf"(?:{names})\z")


def manifest_type(path: Column) -> Column:
    result = F.lit(None).cast("string")
    for name in reversed(rules.MANIFEST_ECOSYSTEMS):
        result = F.when(F.endswith(F.lower(path), F.lit(name)), F.lit(name)).otherwise(result)
    return result


def path_percent(path: Column, classes: Sequence[tuple]) -> Column:
    """Weight of a path in hundredths; whole numbers keep weighted sums exact."""
    lower = F.lower(path)
    result = F.lit(100)
    for parts, starts, ends, weight in reversed(classes):
        tests = [patterns.literal(p) for p in parts]
        tests += [r"\A" + patterns.literal(p) for p in starts]
        tests += [patterns.literal(p) + r"\z" for p in ends]
        result = F.when(lower.rlike("|".join(tests)), F.lit(round(weight * 100))).otherwise(result)
    return result


def code_percent(path: Column) -> Column:
    return path_percent(path, rules.CODE_PATH_WEIGHTS)


def manifest_percent(path: Column) -> Column:
    return path_percent(path, rules.MANIFEST_PATH_WEIGHTS)


def repo_of_url(url: Column) -> Column:
    """``{owner, repo}`` of a repository address, or null if it is not one (operator C11)."""
    # [scheme:]//authority/path[;params][?query][#fragment]; tabs and line feeds do not count.
    head = r"\A(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//"
    clean = F.regexp_replace(url, r"\A[\x00-\x20]+|[\t\r\n]", "")
    authority = F.regexp_extract(clean, head + r"([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(clean, head + r"[^/?#]*([^?#]*)", 1), r";[^/]*\z", "")
    parts = F.filter(F.split(path, "/", -1), lambda p: p != "")
    return F.when(
        authority.isin(*rules.REPO_HOSTS) & (F.size(parts) >= 2),
        F.struct(
            F.get(parts, F.lit(0)).alias("owner"),
            F.replace(F.get(parts, F.lit(1)), F.lit(".git"), F.lit("")).alias("repo"),
        ),
    )
