"""Stated intent against observed behaviour (operators P9, C20, C21)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.columns import contains_any, present, strip


def is_meaningful(intent: Column) -> Column:
    """Is an intent specific enough to be compared with the code (operator P9)?"""
    text = F.lower(strip(intent))
    return ~text.isin(*rules.GENERIC_INTENTS) & (F.length(text) >= rules.MIN_INTENT_LENGTH)


def mismatches(intent: Column, touches: Column) -> Column:
    """``{message, penalty}`` per behaviour the intent does not announce (operator C20)."""
    meaningful = is_meaningful(intent)
    lower = F.lower(intent)
    checks = [
        (F.array_contains(touches, touch) & meaningful & ~contains_any(lower, words), message, penalty)
        for touch, penalty, message, words in rules.INTENT_CHECKS
    ]
    checks.append(
        (F.array_contains(touches, rules.SECRETS_TOUCH), rules.SECRET_MISMATCH, rules.SECRET_PENALTY)
    )
    return present(
        F.when(test, F.struct(F.lit(message).alias("message"), F.lit(float(penalty)).alias("penalty")))
        for test, message, penalty in checks
    )


def behavior_sentences(touches: Column, findings: Column, mismatch_count: Column) -> Column:
    """Ordered summary sentences of a file (operator C21)."""
    found = [
        F.when(F.array_contains(touches, name), F.lit(sentence))
        for name, sentence in rules.BEHAVIOR_SENTENCES.items()
    ]
    found += [
        F.when(F.array_contains(F.transform(findings, lambda f: f["pattern"]), key), F.lit(sentence))
        for key, sentence in rules.CHAIN_SENTENCES.items()
    ]
    found.append(F.when(mismatch_count > 0, F.lit(rules.MISMATCH_SENTENCE)))
    sentences = present(found)
    return F.when(F.size(sentences) == 0, F.array(F.lit(rules.QUIET_SENTENCE))).otherwise(sentences)
