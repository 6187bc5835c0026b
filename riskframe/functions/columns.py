"""Small column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.patterns import SPACE, any_of, branches, jvm, literal, starts


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    Catalyst may inline a column into every place that reads it, and a lambda reads it once per
    element; binding it to a lambda variable keeps an expensive value computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rows_of(array: Column | str) -> Column:
    """An array to explode.

    Exploding a bare column makes Catalyst add a ``size > 0`` filter and push it down through
    every projection, which computes the whole column a second time; an expression does not.
    """
    return F.filter(array, lambda x: x.isNotNull())


def present(items: Iterable[Column]) -> Column:
    """The non-null members of a fixed list of columns, as an array."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def strip(text: Column) -> Column:
    """Trim all Unicode white space, as Python's ``str.strip`` does."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


# Letters of prose, most frequent first; all other characters but the blank are rarer.
_FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"
# Marks that prose hardly has: one of them alone tells most texts.
_MARKS = "{_"


def rarest_part(word: str) -> str:
    """A mark that a word holds, else the word from its rarest character on, three characters of it at least."""
    mark = next((c for c in _MARKS if c in word), None)
    if mark:
        return mark
    rank = lambda i: _FREQUENT.find(word[i]) % len(_FREQUENT + "?")
    return word[max(range(max(1, len(word) - 2)), key=rank):]


def holds(text: Column, word: str) -> Column:
    """Whether a text holds a word.

    A search stops at each occurrence of its first character, so the part from the rarest one on is looked for first.
    """
    part = rarest_part(word)
    whole = F.contains(text, F.lit(word))
    return whole if part == word else F.contains(text, F.lit(part)) & whole


def holds_any(text: Column, words: Iterable[str]) -> Column:
    """:func:`contains_any` by plain searches: on a long text each costs a fraction of one branch of a pattern."""
    return reduce(or_, [holds(text, word) for word in words], F.lit(False))


def held_words(text: Column, words: Iterable[str]) -> Column:
    """Those of ``words`` that a text holds, each searched once; one that holds another word only if that was found."""
    words = list(dict.fromkeys(words))
    roots = [w for w in words if not any(v in w for v in words if v != w)]

    def longer(t: Column, found: Column) -> list[Column]:
        known = {w: F.array_contains(found, next(r for r in roots if r in w)) for w in words if w not in roots}
        return [F.when(there & F.contains(t, F.lit(w)), F.lit(w)) for w, there in known.items()]

    def some(items: list[Column]) -> Column:
        return present(items) if items else F.array().cast("array<string>")

    return let(text, lambda t: let(
        some([F.when(holds(t, w), F.lit(w)) for w in roots]), lambda found: F.concat(found, some(longer(t, found)))
    ))


def starting_words(patterns: Iterable[str]) -> list[str]:
    """The texts that the alternatives of Python-dialect patterns start with, as far as they can be read off."""
    return list(dict.fromkeys(w for p in patterns for branch in branches(p) for w in starts(branch)))


def matches_any(text: Column, patterns: Iterable[str], held: Column | None = None) -> Column:
    """Whether one of several patterns is found; each alternative is tried alone, and only where the text holds what it starts with.

    ``held`` may bring the :func:`held_words` of the text, all :func:`starting_words` of the patterns among those asked for.
    """
    tests, unread = [], []
    for branch in [b for p in patterns for b in branches(p)]:
        words = starts(branch)
        if words:
            there = holds_any(text, words) if held is None else F.arrays_overlap(held, F.array(*map(F.lit, words)))
            tests.append(there & text.rlike(jvm(branch)))
        else:
            unread.append(branch)
    if unread:
        tests.append(text.rlike(any_of(unread)))
    return reduce(or_, tests, F.lit(False))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    """True if ``text`` holds one of ``words``."""
    return text.rlike("|".join(literal(word) for word in words))


def quoted(value: object) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(mapping: dict, key: Column, default: object) -> Column:
    """A fixed mapping as a column expression."""
    pairs = ", ".join(f"{quoted(k)}, {quoted(v)}" for k, v in mapping.items())
    return F.coalesce(F.try_element_at(F.expr(f"map({pairs})"), key), F.lit(default))


def round2(value: Column) -> Column:
    """Round to two decimals on the exact binary value, half to even, as Python's ``round`` does."""
    return F.call_function("format_number", value, F.lit("0.00")).cast("double")
