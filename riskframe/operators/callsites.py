"""Call sites of text that parses as Python, scored (operators F1-F3).

Catalyst cannot express their extraction.  Python sees a text only if it names a watched target;
it returns compact facts, and all scoring happens on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe import rules, texts
from riskframe.functions.columns import holds_any, lookup, rows_of
from riskframe.operators.detect import BEHAVIOR, CALL_RANK, finding, literal_discount
from riskframe.operators.python_facts import python_facts
from riskframe.operators.syntax import NAMES


def gated(text: Column) -> Column:
    """The text if it may name a watched target, so most texts never reach Python."""
    beyond_ascii = F.octet_length(text) != F.length(text)
    return F.when(beyond_ascii | holds_any(text, NAMES), text)


def call_sites_column(text: Column) -> Column:
    """The call sites of a text (operator F1)."""
    return python_facts(code=gated(text))["sites"]


def call_findings(sites: Column) -> Column:
    """Scored findings of call sites (operator F2)."""
    points = {r.key: float(r.points) for r in rules.BEHAVIOR_RULES}
    messages = {r.key: r.message for r in rules.BEHAVIOR_RULES}

    def score(s: Column) -> Column:
        has_args = s["arg_kind"] != "none"
        trusted = (
            has_args & s["pattern"].isin(*rules.TRUSTED_NETWORK_KEYS)
            & s["fn_name"].isin(*rules.TRUSTED_NETWORK_FUNCTIONS)
        )
        variable, built, literal = (s["arg_kind"] == kind for kind in ("name", "built", "literal"))
        boost = (
            F.when(s["arg_tainted"], 12.0).otherwise(0.0)
            + F.when(variable | built, 4.0).when(literal, -literal_discount(s["pattern"])).otherwise(0.0)
            - F.when(trusted, 2.0).otherwise(0.0)
        )
        note = F.concat_ws(
            " ",
            F.when(s["arg_tainted"], texts.NOTE_CALL_TAINTED),
            F.when(variable, texts.NOTE_CALL_VARIABLE).when(built, texts.NOTE_CALL_BUILT)
            .when(literal, texts.NOTE_LITERAL),
            F.when(trusted, texts.NOTE_CALL_TRUSTED),
        )
        return finding(
            s["line"], s["pattern"], lookup(points, s["pattern"], 0.0) + boost, CALL_RANK, s["seq"],
            F.lit(BEHAVIOR), lookup(messages, s["pattern"], ""), note,
        )

    return F.transform(sites, score)


def call_site_rows(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per watched call (operator F1)."""
    keys = [c for c in files.columns if c != text]
    return files.select(*keys, F.explode(rows_of(call_sites_column(F.col(text)))).alias("site")).select(*keys, "site.*")


def call_finding_rows(files: DataFrame, text: str = "content") -> DataFrame:
    """One row per scored call finding (operators F1, F2)."""
    keys = [c for c in files.columns if c != text]
    return files.select(
        *keys, F.explode(rows_of(call_findings(call_sites_column(F.col(text))))).alias("finding")
    ).select(*keys, "finding.*")
