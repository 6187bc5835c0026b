"""The one step of a scan that runs in Python: call sites of a text, and variables that outside data reaches.

Both follow the order of statements with a table of names as state, which no array function keeps in linear time. A text comes
here only if it passes its gate; the facts are compact, and all scoring happens on the JVM. The code is shipped with the query.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.columns import starting_words
from riskframe.functions.patterns import branches, starts
from riskframe.operators import syntax, thinning
from riskframe.operators.syntax import NAMES, gated_call_sites
from riskframe.operators.thinning import foreign_breaks, thinned

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(syntax)
cloudpickle.register_pickle_by_value(thinning)

SITE = [("seq", pa.int32()), ("line", pa.int32()), ("pattern", pa.string()), ("arg_kind", pa.string()), ("arg_tainted", pa.bool_()), ("fn_name", pa.string())]
FACTS = (
    "sites array<struct<seq:int,line:int,pattern:string,arg_kind:string,arg_tainted:boolean,fn_name:string>>, "
    "tainted array<string>, used array<string>"
)

SCAN_FACTS = FACTS.replace("used array<string>", "thin string, broken boolean")

_ASSIGNMENT = re.compile(rules.ASSIGNMENT_PATTERN)
_WORDS = re.compile(r"\w+")


def decoded(text: pa.StringScalar) -> str:
    """A text; bytes that are no UTF-8 become replacement characters, as on the JVM."""
    return text.as_buffer().to_pybytes().decode("utf-8", "replace")


def propagated(text: str, source: re.Pattern) -> dict[str, int]:
    """Tainted variables of a text with their place in first-taint order.

    An assignment taints its variable if its line holds a source or, as a whole word, a name tainted before. Each line looks up
    its own words only, so the time follows the text and not the number of names.
    """
    names: dict[str, int] = {}
    for line in text.split("\n"):
        assigned = _ASSIGNMENT.match(line)
        if assigned and assigned[1] not in names:
            lower = line.lower()
            if source.search(lower) or not names.keys().isdisjoint(_WORDS.findall(lower)):
                names[assigned[1]] = len(names)
    return names


def first_used(names: dict[str, int], args: Sequence[str | None]) -> list[str | None]:
    """For each argument text the first tainted variable among its words, in any case."""
    lower: dict[str, str] = {}
    for name in names:
        lower.setdefault(name.lower(), name)
    found = []
    for text in args:
        held = {lower[w] for w in _WORDS.findall((text or "").lower()) if w in lower}
        found.append(min(held, key=names.__getitem__, default=None))
    return found


def python_facts(
    code: Column | None = None, scan_text: Column | None = None, args: Column | None = None,
    sources: Sequence[str] = tuple(rules.TAINT_SOURCES),
) -> Column:
    """A struct ``sites`` of ``code``, ``tainted`` variables of ``scan_text``, and the first one ``used`` in each of ``args``.

    Where a text is null its facts are empty; ``used`` has one entry per argument all the same.
    """
    pattern = "|".join(f"(?:{s})" for s in sources)

    def batch(codes: pa.Array, texts: pa.Array, arguments: pa.Array) -> pa.Array:
        source, sites, tainted, used = re.compile(pattern), [], [], []
        for text in codes:
            sites.append(gated_call_sites(text.as_py()))
        for text, calls in zip(texts, arguments, strict=True):
            names = propagated(text.as_py(), source) if text.is_valid else {}
            tainted.append(list(names))
            used.append(first_used(names, calls.as_py() or []))
        return pa.StructArray.from_arrays(
            [pa.array(sites, pa.list_(pa.struct(SITE))), pa.array(tainted, pa.list_(pa.string())), pa.array(used, pa.list_(pa.string()))],
            ["sites", "tainted", "used"],
        )

    none = F.lit(None).cast("string")
    return F.arrow_udf(batch, FACTS)(
        none if code is None else code, none if scan_text is None else scan_text,
        F.lit(None).cast("array<string>") if args is None else args,
    )


def scan_facts(
    content: Column, counting: Column, words: Sequence[str], sinks: Sequence[str], code: bool, run: int = thinning.RUN,
    sources: Sequence[str] = tuple(rules.TAINT_SOURCES),
) -> Column:
    """A struct of a text: ``thin``, its lines that count and hold one of ``words`` or matter otherwise (:mod:`riskframe.operators.thinning`);
    ``broken``, whether it has other line breaks than line feeds; ``sites``, its call sites, if ``code``; and the ``tainted``
    variables, if it holds one of ``sinks``.

    ``counting`` is the text that counts where excluded blocks left lines out, else null.
    """
    pattern = "|".join(f"(?:{s})" for s in sources)
    readable = all(starts(b) for s in sources for b in branches(s))
    reads = thinning.any_word([*starting_words(sources), "\u0130"]) if readable else ""
    gate = thinning.line_gate([*words, *sinks, *(NAMES if code else ())], run)
    named = thinning.any_word(NAMES) if code else ""
    # Apart from the other words: so many characters make a slow automaton of them all.
    otherwise = thinning.spelled_otherwise() if code else ""
    # A literal inside a word is deleted before the word is looked for.
    sink = thinning.any_word([*sinks, "\u0130"]) + r"""|[^ \n]['"]""" if sinks else ""

    def places(texts: pa.Array, pattern: str) -> list[int]:
        """Rows of the texts that hold a pattern."""
        return pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(texts, pattern), False)).to_pylist()

    def naming(contents: pa.Array, thin: pa.Array, cut: pa.Array) -> list[int]:
        """Rows whose text may name a watched target: also in other characters, or on a line that does not count."""
        beyond = pc.indices_nonzero(pc.fill_null(pc.invert(pc.string_is_ascii(contents)), False))
        spelled = [beyond[k].as_py() for k in places(contents.take(beyond), otherwise)]
        return sorted({*places(thin, named), *spelled, *pc.indices_nonzero(cut).to_pylist()})

    def batch(contents: pa.Array, counted: pa.Array) -> pa.Array:
        cut = counted.is_valid()
        thin, texts, broken = thinned(pc.if_else(cut, counted, contents), gate)
        if pc.any(cut).as_py():
            broken = pc.replace_with_mask(broken, cut, foreign_breaks(contents.filter(cut)))
        sites, tainted = [[] for _ in contents], [[] for _ in contents]
        for i in naming(contents, thin, cut) if named else ():
            sites[i] = gated_call_sites(decoded(contents[i]))
        at = places(thin, sink) if sink else []
        source = re.compile(pattern)
        for k in places(texts.take(pa.array(at, pa.int32())), reads):
            tainted[at[k]] = list(propagated(decoded(texts[at[k]]), source))
        return pa.StructArray.from_arrays(
            [pa.array(sites, pa.list_(pa.struct(SITE))), pa.array(tainted, pa.list_(pa.string())), thin.cast(pa.string()), broken],
            ["sites", "tainted", "thin", "broken"],
        )

    # Not really so, but a filter on what follows from the facts would else be moved below them, with a copy of the step at each use.
    return F.arrow_udf(batch, SCAN_FACTS).asNondeterministic()(content, counting)
