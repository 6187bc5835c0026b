"""The advisory snapshot (operator S4): bodies by id, and the package versions each one affects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.functions.columns import rows_of

ADVISORY_SCHEMA = """
id string, summary string, details string, aliases array<string>, published string, modified string,
affected array<struct<
  package: struct<name: string, ecosystem: string>, versions: array<string>,
  ecosystem_specific: struct<severity: string>,
  ranges: array<struct<events: array<struct<introduced: string, fixed: string>>>>>>,
database_specific struct<severity: string>,
severity array<struct<type: string, score: string>>
"""


_FIELDS = ("id", "summary", "details", "published", "modified", "aliases", "affected", "database_specific", "severity")


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisory bodies from JSON lines, with the schema given (no inference pass over the data)."""
    return spark.read.schema(ADVISORY_SCHEMA).json(path)


_STRUCT = "array<struct<package:struct<name:string,ecosystem:string>,versions:array<string>,ecosystem_specific:struct<severity:string>,ranges:array<struct<events:array<struct<introduced:string,fixed:string>>>>>>"


def _string(value: Column, path: str) -> Column:
    """The string at a path; null if something else stands there."""
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    return F.when(kind == "STRING", F.try_variant_get(value, path, "string"))


def _list(value: Column, path: str) -> Column:
    """The members of the list at a path, none if something else stands there: no other value becomes a list."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def _is_object(value: Column) -> Column:
    """Whether a value is an object: no other becomes a map. Its schema would say so too, but takes a walk through all of it."""
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def parse_advisory_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Advisory bodies from JSON texts of any shape: the columns of ``ADVISORY_SCHEMA``, the whole ``body`` as a variant, and
    whether the line is ``bad``: no JSON, or no object.

    A field of another type than the schema's counts as missing, as it does for a reader that tests types before use: a severity
    that is an object or a text, aliases that are numbers, versions that are no list. Nothing of the body is lost, so fields that
    the schema does not know can be read later.
    """
    body = F.col("body")
    # Exploded, not projected: a filter on the body would be pushed below a projection and parse each line once more.
    parsed = lines.select("*", F.explode(F.array(F.try_parse_json(column))).alias("body")).withColumn("bad", ~_is_object(body))

    def events(a: Column) -> Column:
        return F.transform(_list(a, "$.events"), lambda e: F.struct(_string(e, "$.introduced").alias("introduced"), _string(e, "$.fixed").alias("fixed")))

    def affected(a: Column) -> Column:
        return F.struct(
            F.struct(_string(a, "$.package.name").alias("name"), _string(a, "$.package.ecosystem").alias("ecosystem")).alias("package"),
            F.transform(_list(a, "$.versions"), lambda v: _string(v, "$")).alias("versions"),
            F.struct(_string(a, "$.ecosystem_specific.severity").alias("severity")).alias("ecosystem_specific"),
            F.transform(_list(a, "$.ranges"), lambda r: F.struct(events(r).alias("events"))).alias("ranges"),
        )

    def scored(item: Column) -> Column:
        score = F.try_variant_get(item, "$.score", "variant")
        return F.struct(_string(item, "$.type").alias("type"), F.coalesce(_string(item, "$.score"), F.to_json(score)).alias("score"))

    return parsed.select(
        *[c for c in lines.columns if c != column],
        *[_string(body, f"$.{name}").alias(name) for name in ("id", "summary", "details", "published", "modified")],
        F.transform(_list(body, "$.aliases"), lambda a: _string(a, "$")).alias("aliases"),
        F.transform(F.filter(_list(body, "$.affected"), _is_object), affected).cast(_STRUCT).alias("affected"),
        F.struct(_string(body, "$.database_specific.severity").alias("severity")).alias("database_specific"),
        F.transform(F.filter(_list(body, "$.severity"), _is_object), scored).cast("array<struct<type:string,score:string>>").alias("severity"),
        "body", "bad", F.col(column).alias("line"),
    )


def read_advisory_lines(spark: SparkSession, path: str) -> DataFrame:
    """:func:`parse_advisory_lines` of the JSON lines below a path."""
    return parse_advisory_lines(spark.read.text(path))


def good_advisories(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("bad")).drop("bad", "line")


def bad_lines(parsed: DataFrame) -> DataFrame:
    """The lines that are no JSON object."""
    return parsed.where(F.col("bad")).select(*[c for c in parsed.columns if c not in ("body", "bad", *_FIELDS)])


def advisory_refs(advisories: DataFrame) -> DataFrame:
    """``(ecosystem, package, version, id)``: every version an advisory lists explicitly."""
    return (
        advisories.select("id", F.explode(rows_of("affected")).alias("a"))
        .select(
            F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("package"),
            F.explode("a.versions").alias("version"), "id",
        )
        .distinct()
    )


def nest_advisories(flat: DataFrame) -> DataFrame:
    """Advisory bodies from a flat table with one affected version and one fix per row."""
    blank = F.lit(None).cast("string")
    return flat.select(
        "id", "summary", blank.alias("details"),
        F.array(F.concat(F.lit(" CVE-"), "id"), F.lit(" ")).alias("aliases"),
        blank.alias("published"), blank.alias("modified"),
        F.array(F.struct(
            F.struct(F.col("package").alias("name"), "ecosystem").alias("package"),
            F.array("version").alias("versions"),
            F.struct(F.col("severity")).alias("ecosystem_specific"),
            F.array(F.struct(F.array(
                F.struct(F.lit("0").alias("introduced"), blank.alias("fixed")),
                F.struct(blank.alias("introduced"), F.concat("fixed", F.lit(" ")).alias("fixed")),
                F.struct(blank.alias("introduced"), F.col("fixed").alias("fixed")),
            ).alias("events"))).alias("ranges"),
        )).alias("affected"),
        F.struct(blank.alias("severity")).alias("database_specific"),
        F.array().cast("array<struct<type:string,score:string>>").alias("severity"),
    )
