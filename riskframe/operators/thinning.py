"""Texts thinned to the lines that can matter to a rule: one linear search for all words at once, in Arrow.

A search per word, the lower case, literals and patterns of whole texts cost many times the reading of them. Nearly all lines of a
large corpus hold no word of any rule; here each of those becomes a placeholder, so line numbers stay and all further work follows
the few lines that are left. The code is shipped with the query.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc

from riskframe.functions.patterns import SPACE

#: Stands for a line without interest; no pattern reads it as a blank, a word or a mark.
PLACEHOLDER = "~"
#: Characters of a run that may be part of an encoded text, few enough for a small automaton.
RUN = 60
_BREAKS = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"

# Lines that change what is found on others: literals may begin, end or fail to end on them; white space between a word and its
# parenthesis may cross lines; a definition names the function of the lines below it. I with a dot becomes an ASCII letter in lower
# case, which a search in any case does not know; lines cut by a rare break are told apart afterwards.
_OTHERS = (
    r"""['"\\\x{130}\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"""
    rf"|^[{SPACE}]*(?:\(|$|def[{SPACE}])"
)


def any_word(words: Iterable[str]) -> str:
    """A pattern of Arrow's dialect that finds one of several words in any case."""
    return "(?i:" + "|".join(re.sub(r"([!-/:-@\[-^`{-~])", r"\\\1", word) for word in dict.fromkeys(words)) + ")"


@cache
def spelled_otherwise() -> str:
    """The characters beyond ASCII that become ASCII letters or an underscore in normal form, as a class."""
    spans: list[list[int]] = []
    for code in range(128, sys.maxunicode + 1):
        if unicodedata.decomposition(chr(code)) and re.search("[A-Za-z_]", unicodedata.normalize("NFKC", chr(code))):
            if spans and spans[-1][1] == code - 1:
                spans[-1][1] = code
            else:
                spans.append([code, code])
    return "[" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in spans) + "]"


def line_gate(words: Iterable[str], run: int = RUN) -> str:
    """The pattern of lines to keep: those that hold a word in any case, a long run, or that change what is found on others."""
    return rf"{any_word(words)}|[A-Za-z0-9+/]{{{run}}}|{_OTHERS}"


def foreign_breaks(texts: pa.Array) -> pa.Array:
    """Whether each text holds other line breaks than line feeds."""
    return pc.fill_null(pc.match_substring_regex(texts, _BREAKS), False)


def thinned(texts: pa.Array, gate: str) -> tuple[pa.Array, pa.Array, pa.Array]:
    """The thinned texts, the texts with line feeds as their only line breaks, and whether there were others."""
    broken = pa.repeat(False, len(texts))
    lines = pc.split_pattern(texts, "\n")
    flat = lines.flatten()
    kept = pc.match_substring_regex(flat, gate)
    if pc.any(foreign_breaks(flat.filter(kept))).as_py():
        broken = foreign_breaks(texts)
        mended = pc.replace_substring_regex(texts.filter(broken), pattern=_BREAKS, replacement="\n")
        texts = pc.replace_with_mask(texts, broken, mended)
        lines = pc.split_pattern(texts, "\n")
        flat = lines.flatten()
        kept = pc.match_substring_regex(flat, gate)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lines), 0)).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    left = pc.if_else(kept, flat, pa.scalar(PLACEHOLDER, flat.type))
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, left), pa.scalar("\n", flat.type))
    # The line feed of the last line starts no further one.
    joined = pc.replace_substring_regex(joined, pattern=r"\n\z", replacement="")
    return pc.if_else(pc.is_valid(texts), joined, pa.scalar(None, joined.type)), texts, broken
