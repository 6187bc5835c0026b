"""Declared versions of dependencies (operators C13, C14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions import patterns
from riskframe.functions.columns import let, strip

_UNSUPPORTED = r"\A(?:" + "|".join(patterns.literal(p) for p in rules.UNSUPPORTED_VERSION_PREFIXES) + ")"
_UNRESOLVED = r"\|\|| - |[<>*xX]"
_LEADING = patterns.jvm(r"\A\s*[=v]+\s*")
_EXACT = r"\A[0-9A-Za-z][0-9A-Za-z.\-+_]*\z"


def normalize_version(raw: Column) -> Column:
    """``{version, kind}``: exact, range-normalized, or unresolved without a version."""

    def result(version, kind) -> Column:
        return F.struct(version.alias("version"), F.lit(kind).alias("kind"))

    def judge(v: Column) -> Column:
        bare = F.regexp_replace(v, _LEADING, "")
        base = strip(F.substr(bare, F.lit(2)))
        unresolved = result(F.lit(None).cast("string"), "unresolved")
        return (
            F.when((v == "") | F.lower(v).rlike(_UNSUPPORTED) | v.rlike(_UNRESOLVED), unresolved)
            .when(bare.rlike(r"\A[\^~]") & (base != ""), result(base, "range-normalized"))
            .when(bare.rlike(_EXACT), result(bare, "exact"))
            .otherwise(unresolved)
        )

    unquoted = F.regexp_replace(strip(F.coalesce(raw, F.lit(""))), r"""\A["']+|["']+\z""", "")
    return let(unquoted, judge)


def package_name(name: Column) -> Column:
    """A requirement's package without its extras."""
    return strip(F.substring_index(strip(name), "[", 1))
