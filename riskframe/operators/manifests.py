"""Dependency manifests (operators C13-C16, W4, U2, A8, O3).

Parsed and skipped entries come from one pass: every manifest entry becomes a row with either a
version or a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions import patterns
from riskframe.functions.columns import let, present, rows_of, strip
from riskframe.functions.paths import manifest_type
from riskframe.functions.text import split_lines
from riskframe.functions.versions import normalize_version, package_name

_REQUIREMENT = patterns.jvm(r"\A" + rules.REQUIREMENT_PATTERN)
_INDIRECT = r"\A(?:" + "|".join(patterns.literal(p) for p in rules.INDIRECT_REQUIREMENT_PREFIXES) + ")"

ENTRY_COLUMNS = [
    "file", "manifest_type", "line", "package", "ecosystem", "declared_version", "version",
    "version_kind", "dependency_section", "raw", "reason", "section_ord", "pos",
]


def requirement_entries(lines: DataFrame) -> DataFrame:
    """Parse requirement lines (operator C15).

    ``lines`` has ``file``, ``line`` and ``raw``; other columns pass through.  Blank lines and
    comments yield nothing, every other line one row.
    """
    keys = [c for c in lines.columns if c not in ("file", "line", "raw")]
    text = F.col("_text")
    bare = strip(F.substring_index(strip(F.substring_index(text, " #", 1)), ";", 1))

    def parse(b: Column) -> Column:
        declared = F.concat(F.regexp_extract(b, _REQUIREMENT, 2), F.regexp_extract(b, _REQUIREMENT, 3))
        return F.struct(
            b.rlike(_REQUIREMENT).alias("parsed"),
            package_name(F.regexp_extract(b, _REQUIREMENT, 1)).alias("package"),
            F.regexp_extract(b, _REQUIREMENT, 3).alias("raw_version"),
            declared.alias("declared"), normalize_version(declared).alias("norm"),
        )

    indirect = text.rlike(_INDIRECT)

    def relevant(b: Column) -> Column:
        return (text != "") & ~F.startswith(text, F.lit("#")) & (indirect | (b != ""))

    # Lines that are no entry are left out of the array: a filter on them would be pushed down and strip each line once more.
    entry = let(bare, lambda b: F.when(relevant(b), let(parse(b), lambda p: F.struct(
        p["package"].alias("package"), p["declared"].alias("declared"), p["norm"].alias("norm"),
        F.when(indirect, rules.SKIP_INDIRECT)
        .when(~p["parsed"], rules.SKIP_UNPARSED)
        .when(p["raw_version"] == "", rules.SKIP_UNPINNED)
        .when(p["norm"]["version"].isNull(), rules.SKIP_COMPLEX).alias("reason"),
    ))))
    rows = lines.withColumn("_text", strip(F.col("raw"))).select(
        *keys, "file", "line", text.alias("raw"), F.explode(rows_of(F.array(entry))).alias("e")
    )
    ok = F.col("e.reason").isNull()
    return rows.select(
        *keys, "file", F.lit("requirements.txt").alias("manifest_type"), F.col("line").cast("int").alias("line"),
        F.when(ok, F.col("e.package")).alias("package"), F.lit("PyPI").alias("ecosystem"),
        F.when(ok, F.col("e.declared")).alias("declared_version"), F.col("e.norm.version").alias("version"),
        F.when(ok, F.col("e.norm.kind")).alias("version_kind"),
        F.lit(None).cast("string").alias("dependency_section"), "raw", F.col("e.reason").alias("reason"),
        F.lit(0).alias("section_ord"), F.lit(0).alias("pos"),
    )


def package_json_entries(files: DataFrame) -> DataFrame:
    """Parse package.json texts (operator C16): one row per entry of the four sections.

    A section that is not an object is ignored; a text that is not JSON is one skipped row.
    """
    keys = [c for c in files.columns if c not in ("path", "content")]
    sections = rules.PACKAGE_JSON_SECTIONS
    # The text of each value, and its type: both parsers keep the order of keys, and repeated ones.
    parsed = F.struct(*[
        F.from_json("content", ", ".join(f"{s} map<string,{kind}>" for s in sections)).alias(name)
        for name, kind in (("texts", "string"), ("values", "variant"))
    ])
    valid = F.get_json_object("content", "$").isNotNull()

    def entries(doc: Column) -> Column:
        return F.flatten(F.array(*[
            F.coalesce(
                _section_entries(doc, section, n),
                F.array().cast("array<struct<section:string,section_ord:int,pos:int,package:string,value:string>>"),
            )
            for n, section in enumerate(sections)
        ]))

    broken = F.array(F.struct(
        F.lit(None).cast("string").alias("section"), F.lit(0).alias("section_ord"), F.lit(0).alias("pos"),
        F.lit(None).cast("string").alias("package"), F.lit(None).cast("string").alias("value"),
    ))
    rows = files.select(
        *keys, F.col("path").alias("file"),
        F.explode(F.when(valid, let(parsed, entries)).otherwise(broken)).alias("e"),
    ).select("*", F.explode(F.array(normalize_version(F.col("e.value")))).alias("norm"))
    is_broken = F.col("e.section").isNull()
    ok = ~is_broken & F.col("norm.version").isNotNull()
    return rows.select(
        *keys, "file", F.lit("package.json").alias("manifest_type"), F.lit(1).alias("line"),
        F.when(ok, strip(F.col("e.package"))).alias("package"), F.lit("npm").alias("ecosystem"),
        F.when(ok, strip(F.col("e.value"))).alias("declared_version"), F.col("norm.version").alias("version"),
        F.when(ok, F.col("norm.kind")).alias("version_kind"),
        F.when(ok, F.col("e.section")).alias("dependency_section"),
        F.when(is_broken, "").when(~ok, F.concat("e.package", F.lit(": "), "e.value")).alias("raw"),
        F.when(is_broken, rules.SKIP_JSON).when(~ok, F.concat(
            "e.section", F.lit(rules.SKIP_JSON_ENTRY.format(section=""))
        )).alias("reason"),
        F.col("e.section_ord").alias("section_ord"), F.col("e.pos").alias("pos"),
    )


def python_float(text: Column) -> Column:
    """A number as the JVM spells it, ``1.0E-7``, in Python's spelling, ``1e-07``."""
    mantissa = F.regexp_extract(text, r"\A-?([0-9.]+)", 1)
    digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), r"(?<=.)0+\z", "")
    exponent = F.regexp_extract(text, r"E(-?[0-9]+)\z", 1).cast("int")

    def spelled(p: Column) -> Column:
        d, e = p["digits"], p["exponent"]
        n = F.length(d)
        head, rest = F.left(d, F.lit(1)), F.substring(d, 2, 400)
        scientific = F.concat(
            head, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(e < 0, "-").otherwise("+"),
            F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"),
        )
        whole = F.when(n <= e + 1, F.concat(d, F.repeat(F.lit("0"), F.greatest(e + 1 - n, F.lit(0))), F.lit(".0"))).otherwise(
            F.concat(F.left(d, e + 1), F.lit("."), F.substr(d, e + 2))
        )
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0))), d)
        return F.when((e >= 0) & (e < 16), whole).when((e < 0) & (e >= -4), small).otherwise(scientific)

    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    parts = F.struct(digits.alias("digits"), exponent.alias("exponent"))
    return F.when(F.contains(text, F.lit("E")), F.concat(sign, let(parts, spelled))).otherwise(text)


def json_spelling(text: Column, value: Column) -> Column:
    """A JSON value as Python's ``str`` spells it; lists and objects keep their JSON."""
    kind = F.schema_of_variant(value)
    number = F.when(text.rlike(r"\A-?[0-9]+\z"), text).otherwise(python_float(text))
    return (
        F.when(value.isNull() | text.isNull() | (kind == "VOID"), "None").when(kind == "STRING", text)
        .when(kind == "BOOLEAN", F.when(text == "true", "True").otherwise("False"))
        .when(text == '"NaN"', "nan").when(F.contains(text, F.lit('Infinity"')), F.when(F.startswith(text, F.lit('"-')), "-inf").otherwise("inf"))
        .when(kind.rlike(r"\A(?:BIGINT|DOUBLE|DECIMAL)"), number).otherwise(text)
    )


def _section_entries(doc: Column, section: str, order: int) -> Column:
    """Entries of a section; of a key that stands several times, the last value at the first place."""

    def entry(e: Column, i: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"), F.lit(order).alias("section_ord"), i.alias("pos"), e["key"].alias("package"),
            json_spelling(e["text"], e["value"]).alias("value"),
        )

    def listed(m: Column) -> Column:
        rows = F.zip_with(F.map_entries(m["texts"]), F.map_entries(m["values"]), lambda t, v: F.struct(t["key"].alias("key"), t["value"].alias("text"), v["value"].alias("value")))
        keys = F.array_distinct(F.map_keys(m["texts"]))
        last = lambda rows: F.transform(keys, lambda key: F.element_at(F.filter(rows, lambda r: r["key"] == key), -1))
        once = let(rows, lambda rows: F.when(F.size(keys) == F.size(rows), rows).otherwise(last(rows)))
        return F.transform(once, entry)

    maps = F.struct(doc["texts"][section].alias("texts"), doc["values"][section].alias("values"))
    return F.when(doc["texts"][section].isNotNull(), let(maps, listed))


def manifest_entries(files: DataFrame) -> DataFrame:
    """Entries of all manifests of a file table ``(repo, path, content)`` (operator U2)."""
    kind = manifest_type(F.col("path"))
    keys = [c for c in files.columns if c not in ("path", "content")]
    lines = files.where(kind == "requirements.txt").select(
        *keys, F.col("path").alias("file"), F.posexplode(split_lines(F.col("content"))).alias("i", "raw")
    ).select(*keys, "file", (F.col("i") + 1).alias("line"), "raw")
    return requirement_entries(lines).unionByName(package_json_entries(files.where(kind == "package.json")))


def parsed(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("reason").isNull()).drop("reason", "raw")


def skipped(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("reason").isNotNull())


def dedupe_dependencies(dependencies: DataFrame, scope: str = "repo") -> DataFrame:
    """First entry per file, package in any case, ecosystem and version (operator W4).

    An aggregate rather than a window: duplicates collapse before the shuffle.
    """
    keys = [scope, "file", "ecosystem", "version"]
    rest = [c for c in dependencies.columns if c not in (*keys, "line", "section_ord", "pos")]
    first = F.min(F.struct("line", "section_ord", "pos", *rest)).alias("d")
    return (
        dependencies.groupBy(*keys, F.lower("package").alias("_package")).agg(first)
        .select(*keys, "d.*")
    )


def skipped_top(entries: DataFrame, scope: str = "repo", top: int | None = rules.MAX_SKIPPED_REPORTED) -> DataFrame:
    """The first ``top`` skipped entries per repository in parse order, or all (operator O3).

    The literal limit on the row number lets Spark cut every group before the shuffle.
    """
    order = Window.partitionBy(scope).orderBy("file", "line", "section_ord", "pos")
    return (
        skipped(entries).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top if top is not None else F.lit(True))
        .select(scope, "rank", "file", "line", "raw", "reason")
    )


def manifest_counts(entries: DataFrame, manifests: DataFrame, scope: str = "repo") -> DataFrame:
    """Manifests, parsed (after dedupe) and skipped entries per repository (operator A8)."""
    per_repo = manifests.groupBy(scope).agg(F.count(F.lit(1)).alias("manifests_scanned"))
    parsed_key = F.when(
        F.col("reason").isNull(), F.struct("file", F.lower("package"), "ecosystem", "version")
    )
    counts = entries.groupBy(scope).agg(
        F.count_distinct(parsed_key).alias("dependencies_parsed"),
        F.count("reason").alias("dependencies_skipped_count"),
    )
    zero = F.lit(0).cast("bigint")
    return per_repo.join(counts, scope, "left").select(
        scope, "manifests_scanned",
        F.coalesce("dependencies_parsed", zero).alias("dependencies_parsed"),
        F.coalesce("dependencies_parsed", zero).alias("dependencies_queried"),
        F.coalesce("dependencies_skipped_count", zero).alias("dependencies_skipped_count"),
    )


def manifest_sentences(
    manifests: Column, parsed_count: Column, skipped_count: Column, advisories: Column, packages: Column
) -> Column:
    """Summary sentences of a repository's manifests (operator A8)."""
    return present([
        F.when(manifests > 0, F.format_string("Scanned %d dependency manifest file(s).", manifests)),
        F.when(parsed_count > 0, F.format_string(
            "Parsed %d dependency entries with resolvable versions.", parsed_count)),
        F.when(skipped_count > 0, F.format_string(
            "Skipped %d dependency entries with complex or indirect version specs.", skipped_count)),
        F.when(advisories > 0, F.format_string(
            "Found %d dependency advisory finding(s) across %d package/version pair(s).", advisories, packages))
        .when(manifests > 0, F.lit(
            "No known dependency vulnerabilities were found in the queried manifest versions.")),
    ])
