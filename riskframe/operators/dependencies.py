"""Dependencies against the advisory snapshot (operators J1, J2, A6, A7, A13, C17-C19, O2, O4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe import rules, texts
from riskframe.functions.columns import lookup, round2, rows_of, strip
from riskframe.functions.paths import manifest_percent
from riskframe.operators.ranking import ranked_within

_KEYS = ["ecosystem", "package", "version"]


def _filled(values: Column) -> Column:
    """Trimmed members of an array that are not blank, in order."""
    return F.filter(F.transform(values, strip), lambda v: v.isNotNull() & (v != ""))


def _first(values: Column, most: int | None) -> Column:
    return values if most is None else F.slice(values, 1, most)


def severity_label(affected: Column, database: Column, scores: Column) -> Column:
    """Upper-cased severity of an advisory (operator C17)."""
    named = F.get(_filled(F.transform(affected, lambda a: a["ecosystem_specific"]["severity"])), F.lit(0))
    general = F.nullif(strip(database["severity"]), F.lit(""))

    def level(score: Column) -> Column:
        result = F.lit(None).cast("string")
        for word in ("LOW", "MEDIUM", "HIGH", "CRITICAL"):
            result = F.when(F.contains(score, F.lit(word)), word).otherwise(result)
        return result

    scored = F.get(
        F.filter(F.transform(scores, lambda s: level(F.upper(s["score"]))), lambda s: s.isNotNull()), F.lit(0)
    )
    return F.coalesce(F.upper(named), F.upper(general), scored, F.lit("UNKNOWN"))


def fixed_versions(affected: Column, most: int | None = rules.MAX_FIXED_VERSIONS) -> Column:
    """Distinct fixed versions in order (operator A13), the first ``most`` of them or all."""
    events = F.flatten(F.flatten(F.transform(
        affected, lambda a: F.transform(F.coalesce(a["ranges"], F.array().cast(
            "array<struct<events:array<struct<introduced:string,fixed:string>>>>"
        )), lambda r: F.coalesce(r["events"], F.array().cast("array<struct<introduced:string,fixed:string>>"))),
    )))
    found = F.array_distinct(_filled(F.transform(events, lambda e: e["fixed"])))
    return F.coalesce(_first(found, most), F.array().cast("array<string>"))


def severity_points(label: Column) -> Column:
    return lookup(rules.ADVISORY_POINTS, label, rules.ADVISORY_POINTS["UNKNOWN"])


def advisory_facts(
    advisories: DataFrame,
    max_aliases: int | None = rules.MAX_ALIASES,
    max_fixed: int | None = rules.MAX_FIXED_VERSIONS,
) -> DataFrame:
    """The fields a finding needs, one row per advisory: the body is read and cut down once.

    The report's limits on lists are parameters; None keeps everything.
    """
    summary, details = strip(F.col("summary")), strip(F.col("details"))
    return advisories.where(F.col("id").isNotNull()).select(
        "id", severity_label(F.col("affected"), F.col("database_specific"), F.col("severity")).alias("severity_label"),
        fixed_versions(F.col("affected"), max_fixed).alias("fixed_versions"),
        F.coalesce(_first(_filled(F.col("aliases")), max_aliases), F.array().cast("array<string>")).alias("aliases"),
        F.coalesce(
            F.nullif(summary, F.lit("")), F.nullif(details, F.lit("")), F.lit(texts.ADVISORY_DEFAULT_EXPLANATION)
        ).alias("text"),
        "published", "modified",
    )


def dependency_refs(dependencies: DataFrame, refs: DataFrame, tile: int | None = None) -> DataFrame:
    """Dependencies with the id of every advisory on their exact version (operator J1).

    Without a broadcast hint on purpose: neither side is bounded.  Adaptive execution broadcasts the
    snapshot if it turns out small and splits the partitions of a popular package otherwise.

    Where most of the work is in the pairs, ``tile`` cuts both sides into lists of so many rows of one package version. Lists are
    joined and dealt out to the cores before their pairs are made, so a package version is no task's alone, however popular.
    """
    if tile is None:
        return dependencies.join(refs, _KEYS, "inner")
    tiles = _lists(dependencies, "_dependencies", tile).join(_lists(refs, "_refs", tile), _KEYS)
    tasks = TASKS_PER_CORE * dependencies.sparkSession.sparkContext.defaultParallelism
    dealt = tiles.repartition(tasks, *_KEYS, "_dependencies_no", "_refs_no")
    # The filter of rows_of keeps the outer explode out of generated code, which would hold all pairs of a tile at once.
    outer = dealt.select(*_KEYS, "_dependencies", F.explode(rows_of("_refs")).alias("_ref"))
    pairs = outer.select(*_KEYS, "_ref", F.explode("_dependencies").alias("_dependency"))
    return pairs.select(*_KEYS, *[
        F.col(f"{side}.{c}").alias(c) for side, rows in (("_dependency", dependencies), ("_ref", refs)) for c in rows.columns if c not in _KEYS
    ])


#: Dependencies, and references, of one package version in a tile, at most; a pair of lists is shuffled once for up to a million rows.
TILE = 1_000
#: Tasks for each core that tiles are dealt out to.
TASKS_PER_CORE = 4


def _lists(rows: DataFrame, name: str, most: int) -> DataFrame:
    """The rows of each package version as lists ``name`` of at most ``most``, numbered in ``name_no``.

    Numbered in the order of all columns, so that a task that runs again makes the same lists.
    """
    others = [c for c in rows.columns if c not in _KEYS]
    place = F.row_number().over(Window.partitionBy(*_KEYS).orderBy(*others))
    numbered = rows.withColumn(f"{name}_no", F.floor((place - 1) / F.lit(most)))
    return numbered.groupBy(*_KEYS, f"{name}_no").agg(F.collect_list(F.struct(*others)).alias(name))


#: A package version that stands in more than one of so many dependencies is frequent; so many are frequent at most.
FREQUENT_SHARE = 1_000
#: Parts that the dependencies on a frequent package version are dealt out to.
SALTS = 64


def frequent_versions(dependencies: DataFrame, share: int = FREQUENT_SHARE) -> DataFrame:
    """Package versions that hold more than one dependency in ``share``: less than ``share`` rows, whatever the input.

    Counted map-side; the total is a scalar subquery over the counts.
    """
    counts = dependencies.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.where(F.col("n") * share > total).select(*_KEYS)


def salted_refs(dependencies: DataFrame, refs: DataFrame, share: int = FREQUENT_SHARE, salts: int = SALTS) -> DataFrame:
    """:func:`dependency_refs` with explicit heavy hitters.

    Dependencies on a frequent package version are dealt out to ``salts`` parts by their other columns, and its references are
    repeated for each part. So no task holds one package, also where adaptive execution cannot split the join.
    """
    frequent = F.broadcast(frequent_versions(dependencies, share).withColumn("_frequent", F.lit(True)))
    others = [c for c in dependencies.columns if c not in _KEYS]
    part = F.when(F.col("_frequent"), F.pmod(F.xxhash64(*others), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    left = dependencies.join(frequent, _KEYS, "left").withColumn("_part", part).drop("_frequent")
    parts = F.when(F.col("_frequent"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = refs.join(frequent, _KEYS, "left").withColumn("_part", F.explode(parts)).drop("_frequent")
    return left.join(right, [*_KEYS, "_part"]).drop("_part")


def dependency_findings(
    dependencies: DataFrame,
    refs: DataFrame,
    advisories: DataFrame,
    max_aliases: int | None = rules.MAX_ALIASES,
    max_fixed: int | None = rules.MAX_FIXED_VERSIONS,
    max_explanation: int | None = rules.MAX_EXPLANATION_CHARS,
    joined: str | None = None,
) -> DataFrame:
    """One row per dependency and advisory (operators J1, J2, C18, C19).

    The facts are attached to the references by id, and the dependencies meet both in one join: a popular package version has
    many dependencies and many advisories, so the pairs can be far more than either side, and they are not shuffled again. What
    follows from one side is worked out before the pairs are made. With ``joined``, aliases and fixed versions are texts, joined by it.
    """

    def cut(text: Column) -> Column:
        return text if max_explanation is None else F.substring(text, 1, max_explanation)

    facts = advisory_facts(advisories, max_aliases, max_fixed)
    if joined is not None:
        facts = facts.withColumns({name: F.array_join(name, joined) for name in ("aliases", "fixed_versions")})
    facts = facts.withColumns({"text": cut(F.col("text")), "_base": severity_points(F.col("severity_label"))})
    weight = F.col("_percent") / F.lit(100.0)
    noted = dependencies.withColumn("_percent", manifest_percent(F.col("file"))).withColumn("_note", F.when(
        F.col("_percent") < 100, F.format_string(texts.ADVISORY_WEIGHT_NOTE, weight.cast("string"))
    ))
    rows = dependency_refs(noted, refs.where(F.col("id") != "").join(facts, "id"), TILE)
    label, base, note = F.col("severity_label"), F.col("_base"), F.col("_note")
    explanation = F.when(note.isNull(), F.col("text")).otherwise(cut(F.concat("text", note)))
    carried = [
        c for c in dependencies.columns
        if c not in (*_KEYS, "file", "manifest_type", "line", "declared_version", "version_kind",
                     "dependency_section", "section_ord", "pos")
    ]
    return rows.select(
        *carried, F.lit("dependency_vulnerability").alias("type"), "file", "manifest_type", "line", "package",
        "ecosystem", "declared_version", "version", "version_kind",
        F.coalesce("dependency_section", F.lit("")).alias("dependency_section"), "id", "aliases",
        F.concat(
            F.lit("Known vulnerable dependency detected: "), "package", F.lit(" ("), "declared_version", F.lit(")")
        ).alias("message"),
        "severity_label", (base * F.col("_percent") / F.lit(100.0)).alias("severity"),
        base.cast("double").alias("base_severity"), weight.alias("path_weight"),
        explanation.alias("explanation"),
        "published", "modified", "fixed_versions",
        lookup(texts.ADVISORY_WHY, label, texts.ADVISORY_DEFAULT_WHY).alias("why_risky"),
        F.concat(
            F.lit(texts.ADVISORY_CHECK),
            F.when(F.col("version_kind") == "range-normalized", texts.ADVISORY_CHECK_RANGE).otherwise(""),
        ).alias("what_to_check"),
        F.lit(texts.ADVISORY_LEGITIMATE).alias("when_legitimate"), F.lit(texts.ADVISORY_FIX).alias("suggested_fix"),
    )


def finding_totals(dependencies: DataFrame, refs: DataFrame, advisories: DataFrame, scope: str = "repo") -> DataFrame:
    """What :func:`rollup` and ``cents``, the sum of :func:`dependency_points`, say of :func:`dependency_findings`, without its rows.

    A dependency meets one row per package version, with the number of advisories of each severity; ids are counted from the
    different package versions of a repository. So the work follows the two tables and not their pairs.
    """
    points = severity_points(severity_label(F.col("affected"), F.col("database_specific"), F.col("severity"))).alias("points")
    known = refs.where(F.col("id") != "").join(advisories.where(F.col("id").isNotNull()).select("id", points), "id")
    graded = known.groupBy(*_KEYS, "points").agg(F.count(F.lit(1)).alias("n"))
    graded = graded.groupBy(*_KEYS).agg(F.collect_list(F.struct("points", "n")).alias("grades"))
    met = dependencies.select(scope, "file", *_KEYS, manifest_percent(F.col("file")).alias("percent")).join(graded, _KEYS)
    zero = F.lit(0).cast("bigint")
    cents = F.aggregate("grades", zero, lambda s, g: s + g["n"] * F.round(g["points"] * F.col("percent") / F.lit(100.0) * 100).cast("bigint"))
    totals = met.groupBy(scope).agg(
        F.sum(cents).alias("cents"),
        F.sum(F.aggregate("grades", zero, lambda s, g: s + g["n"])).alias("advisory_count"),
        F.count_distinct(F.struct(F.lower("package"), "version")).alias("unique_package_versions"),
        F.count_distinct(F.nullif("file", F.lit(""))).alias("unique_manifest_files"),
    )
    named = dependencies.select(scope, *_KEYS).distinct().join(known.select(*_KEYS, "id").distinct(), _KEYS)
    ids = named.groupBy(F.col(scope).alias("_scope")).agg(F.count_distinct("id").alias("unique_vulnerability_ids"))
    return totals.join(ids, F.col(scope).eqNullSafe(F.col("_scope"))).drop("_scope")


def ranked_findings(findings: DataFrame, scope: str = "repo") -> DataFrame:
    """Findings with their place in the repository's report (operator O2).

    Order: severity from high to low, package in any case, id.  Ranked in two levels, so that one
    huge repository is spread over the cluster.
    """
    keyed = findings.withColumn("_package", F.lower("package")).withColumn("_severity", -F.col("severity"))
    return ranked_within(
        keyed, [scope], ["_severity", "_package"], ["id", "file", "line", "version"], "rank"
    ).drop("_package", "_severity")


def dependency_points(findings: DataFrame, scope: str = "repo") -> DataFrame:
    """Capped dependency points per repository (operator A6), summed in whole hundredths."""
    cents = F.sum(F.round(F.col("severity") * 100).cast("bigint"))
    return findings.groupBy(scope).agg(cents.alias("cents")).select(
        scope, capped_points(F.col("cents")).alias("dependency_risk_points")
    )


def capped_points(cents: Column) -> Column:
    # least() skips nulls, hence the guard: no findings stay null, not the cap.
    return F.when(cents.isNotNull(), round2(F.least(
        F.lit(rules.DEPENDENCY_POINTS_CAP), cents / F.lit(100.0) * F.lit(rules.DEPENDENCY_POINTS_SHARE)
    )))


def rollup(findings: DataFrame, scope: str = "repo") -> DataFrame:
    """Counts of findings, package versions, manifests and ids per repository (operator A7).

    Distinct values are shuffled by value first and only their partial counts by repository.
    """
    return findings.groupBy(scope).agg(
        F.count(F.lit(1)).alias("advisory_count"),
        F.count_distinct(F.struct(F.lower("package"), "version")).alias("unique_package_versions"),
        F.count_distinct(F.nullif("file", F.lit(""))).alias("unique_manifest_files"),
        F.count_distinct(F.nullif("id", F.lit(""))).alias("unique_vulnerability_ids"),
    )
