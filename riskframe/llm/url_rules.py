"""URL filter: explicit rules, and association rules over URL tokens for the urls that no explicit rule fits. DataFrame functions only.

1. A url's host and path are cut out; of the explicit rules that fit, the longest decides.
2. The urls that a rule decides are the labelled ones (or any others the caller gives). Spark's FP-growth mines combinations of
   tokens (host labels and path segments) that imply a verdict. Every token that meets ``min_support`` takes part. Rules below
   ``min_support`` or ``min_confidence`` are pruned, and so are rules that a shorter one with at least their confidence makes
   superfluous. Hence tokens of one verdict only, or of all urls, are rules by themselves and no items, and of tokens that stand
   in the same urls one is an item; this keeps combinations few and loses no rule.
3. An inverted index lists each rule under the rarest of its tokens. A url meets the rules listed under its tokens and fits those
   whose tokens it holds all. The most confident rule decides, then the one of larger support, then the longer one, then the first
   by its tokens; without a rule the verdict is ``allow``.

Matching is done once for each set of tokens. Null urls and urls without ``://`` have an empty host and path and no tokens. Rows that
repeat an id keep a row each. Without labelled urls there are no mined rules.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import packed, table, unpacked, whole_text, written

#: Host, path and verdict of each rule.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
#: No limit on the tokens that take part in mining.
MAX_ITEMS = None
VERDICTS = ("allow", "block")
_VERDICT = "verdict="
_PIECE = 10_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``rule`` and ``verdict`` of the longest rule that fits, else null."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens, sorted: each label of the host, and each segment of the path."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host="), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path="), x))
    return F.array_sort(F.array_distinct(F.filter(F.concat(labels, segments), lambda x: ~x.endswith("="))))


def _superfluous(found: DataFrame) -> DataFrame:
    """``tokens, verdict`` of the rules of which dropping one token gives a rule of the same verdict that is as confident."""
    shorter = found.select("tokens", "verdict", F.col("confidence").alias("own"), F.explode("tokens").alias("x")).withColumn("less", F.array_remove("tokens", F.col("x")))
    kept = found.select(F.col("tokens").alias("less"), "verdict", F.col("confidence").alias("other"))
    return shorter.join(kept, ["less", "verdict"]).filter("other >= own").select("tokens", "verdict").distinct()


def _twins(sets: DataFrame, tokens: DataFrame) -> DataFrame:
    """``token, first, n``: the first of the tokens that stand in the same urls; from ``tokens`` (``token, n``) and the ``sets`` they stand in."""
    held = sets.select("set_id", "n_urls", F.explode("tokens").alias("token")).join(tokens, "token")
    other = held.select("set_id", F.col("token").alias("first"), F.col("n").alias("n_first"))
    together = held.join(other, "set_id").filter("first <= token and n = n_first").groupBy("token", "first", "n").agg(F.sum("n_urls").alias("n_both"))
    return together.filter("n_both = n").groupBy("token", "n").agg(F.min("first").alias("first"))


def _with_twins(found: DataFrame, twins: DataFrame) -> DataFrame:
    """``found`` and the same rules with other tokens of the same urls in place of the first ones."""
    choices = twins.groupBy("first").agg(F.collect_list("token").alias("members"))
    rule = ["rule", "verdict", "confidence", "support"]
    listed = found.withColumnRenamed("tokens", "rule").select(*rule, F.explode("rule").alias("first")).join(choices, "first")
    listed = listed.groupBy(*rule).agg(F.collect_list("members").alias("choices"))
    none = F.array(F.array().cast("array<string>"))
    chosen = F.aggregate("choices", none, lambda acc, members: F.flatten(F.transform(acc, lambda done: F.transform(members, lambda m: F.array_append(done, m)))))
    return listed.select(F.explode(chosen).alias("tokens"), "verdict", "confidence", "support").withColumn("tokens", F.array_sort("tokens"))


def _repeated(baskets: DataFrame) -> DataFrame:
    """A ``basket`` for each of its ``n_urls`` urls, dealt out in pieces, so that a frequent one fills neither an array nor a task."""
    baskets = baskets.groupBy("basket").agg(F.sum("n_urls").alias("n"))
    pieces = baskets.select("basket", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(_PIECE).cast("long"))).alias("at")).repartition("basket", "at")
    return pieces.select("basket", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n") - F.col("at"), F.lit(_PIECE)))).alias("nth")).select("basket")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``tokens`` (sorted), ``verdict``, ``confidence``, ``support`` of the rules, from ``labelled``: the ``tokens`` and the ``verdict`` of every url."""
    labelled = labelled.groupBy("tokens", "verdict").agg(F.count("*").alias("n_urls"))
    labelled = written(labelled.withColumn("set_id", F.monotonically_increasing_id()), "labelled")
    total = labelled.agg(F.sum("n_urls")).first()[0]
    schema = "tokens array<string>, verdict string, confidence double, support double"
    if not total:
        return labelled.sparkSession.createDataFrame([], schema)
    n_of = {v: F.sum(F.when(F.col("verdict") == v, F.col("n_urls")).otherwise(0)).alias(f"n_{v}") for v in VERDICTS}
    tokens = labelled.select("verdict", "n_urls", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("n_urls").alias("n"), *n_of.values())
    # A rule's urls are at least min_support of all, so each of its tokens stands in as many.
    tokens = written(tokens.filter(F.greatest(*[f"n_{v}" for v in VERDICTS]) >= min_support * total), "tokens")
    # Tokens of a single verdict, and those of all urls, add nothing to a larger set: each larger rule is superfluous.
    alone = F.greatest(*[F.col(f"n_{v}") for v in VERDICTS], F.when(F.col("n") == total, F.col("n"))) == F.col("n")
    by_verdict = F.explode(F.array(*[F.struct(F.lit(v).alias("verdict"), F.col(f"n_{v}").alias("n_both")) for v in VERDICTS]))
    single = tokens.filter(alone).select("token", "n", by_verdict.alias("v")).select(F.array("token").alias("tokens"), "v.verdict", (F.col("v.n_both") / F.col("n")).alias("confidence"), (F.col("v.n_both") / total).alias("support"))
    single = single.filter((F.col("confidence") >= min_confidence) & (F.col("support") >= min_support))
    # Of tokens that stand in the same urls no rule needs two: one is mined, and the rules are then read with each of them.
    twins = written(_twins(labelled, tokens.filter(~alone).select("token", "n")), "twins")
    items = labelled.select("set_id", F.explode("tokens").alias("token")).join(twins.filter("token = first").select("token"), "token")
    items = items.groupBy("set_id").agg(F.collect_list("token").alias("items"))
    basket = F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit(_VERDICT), F.col("verdict")))
    baskets = labelled.join(items, "set_id", "left").select(F.array_sort(basket).alias("basket"), "n_urls")
    model = FPGrowth(itemsCol="basket", minSupport=min_support, minConfidence=min_confidence).fit(_repeated(baskets))
    found = model.associationRules.filter(F.col("consequent")[0].startswith(_VERDICT) & ~F.exists("antecedent", lambda x: x.startswith(_VERDICT)))
    found = found.select(F.array_sort("antecedent").alias("tokens"), F.substr(F.col("consequent")[0], F.lit(len(_VERDICT) + 1)).alias("verdict"), "confidence", "support")
    found = written(found, "mined")
    kept = found.join(_superfluous(found), ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support")
    return _with_twins(kept, twins).unionByName(single)


def matched(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """``tokens``, ``verdict``, ``confidence``, ``mined_rule`` of every distinct set of tokens that fits a rule."""
    # The index: each rule under its rarest token, by the support of the single tokens among the rules' own.
    postings = rules.withColumn("rule", F.col("tokens")).select("rule", "verdict", "confidence", "support", F.explode("tokens").alias("token"))
    common = postings.groupBy("token").agg(F.count("*").alias("n_rules"))
    rarest = postings.join(common, "token").groupBy("rule", "verdict").agg(F.min_by("token", F.struct("n_rules", "token")).alias("token"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    index = written(rarest, "index")
    met = token_sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("rule", "tokens")) == 0)
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.size("rule"), F.col("rule"), F.col("verdict"))
    best = met.groupBy("tokens").agg(F.min_by(F.struct("verdict", "confidence", "rule"), order).alias("best"))
    return best.select("tokens", F.col("best.verdict").alias("verdict"), F.col("best.confidence").alias("confidence"), F.col("best.rule").alias("mined_rule"))


def judge(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``pages`` (with ``url``) and ``host``, ``path``, ``rule``, ``verdict``, and ``confidence`` and ``mined_rule`` where a mined rule decides.

    ``labelled``: other urls to learn from (``url``, ``verdict``) instead of those that a rule decides.
    """

    def parted(df: DataFrame, url: Column) -> DataFrame:
        df = df.withColumn("host", host_of(url)).withColumn("path", path_of(url))
        return df.withColumn("tokens", tokens_of(F.col("host"), F.col("path")))

    rows = packed(pages)
    rows = parted(rows, whole_text(F.col("row.url"))).withColumn("by_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    if labelled is None:
        known = rows.filter("by_rule is not null").select("tokens", F.col("by_rule.verdict").alias("verdict"))
    else:
        known = parted(labelled.select("url", "verdict"), whole_text("url")).filter(F.col("verdict").isin(*VERDICTS)).select("tokens", "verdict")
    mined = mine(known, min_support, min_confidence)
    sets = rows.filter("by_rule is null").select("tokens").distinct()
    best = matched(sets, mined).select(F.col("tokens").alias("set"), F.col("verdict").alias("mined_verdict"), "confidence", "mined_rule")
    judged = rows.join(best, F.col("by_rule").isNull() & (F.col("tokens") == F.col("set")), "left")
    judged = judged.withColumn("rule", F.col("by_rule.rule")).withColumn("verdict", F.coalesce("by_rule.verdict", "mined_verdict", F.lit("allow")))
    return unpacked(judged, "host", "path", "rule", "verdict", "confidence", "mined_rule")


def op3_url_rules(spark, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict", "confidence", F.array_join("mined_rule", " ").alias("mined_rule"))
