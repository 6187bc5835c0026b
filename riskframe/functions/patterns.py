"""Translate rule patterns from Python's regex dialect.

Python's ``\\w``, ``\\b`` and ``\\s`` are Unicode-aware; Java's are ASCII by default and its
``(?U)`` flag uses other character sets.  The translation spells the sets out, so a pattern means
the same on the JVM as in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

WORD = r"\p{L}\p{N}_"
SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

_TOKEN = re.compile(r"\\.|\[\^?|\]|[^\\\[\]]+", re.DOTALL)


_LEADING = re.compile(
    r"(\(\?<!\[\\w\.\]\)|\\b)"  # (?<![\w.]) or \b in front of
    r"([A-Za-z_][A-Za-z0-9_]*(?![A-Za-z0-9_?*+{])|\((?:[A-Za-z0-9_]+\|)*[A-Za-z0-9_]+\)(?![?*+{]))"  # a word or words
)


def _check_behind(match: re.Match) -> str:
    """Test what precedes a word after the word itself.

    The test looks up Unicode classes; done first it would run at every position of a text, done
    last it runs only where the word stands.
    """
    before = r"[\w.]" if match[1].startswith("(") else r"[\w]"
    word = match[2]
    plain = "(?:" + word[1:] if word.startswith("(") else word
    return f"{word}(?<!{before}{plain})"


def jvm(pattern: str) -> str:
    """The Java pattern equal to ``pattern`` (groups and quantifiers are the same)."""
    pattern = _LEADING.sub(_check_behind, pattern)
    out: list[str] = []
    in_class = False
    tokens = _TOKEN.findall(pattern)
    for position, token in enumerate(tokens):
        if token == r"\w":
            out.append(WORD if in_class else f"[{WORD}]")
        elif token == r"\s":
            out.append(SPACE if in_class else f"[{SPACE}]")
        elif token == r"\b" and not in_class:
            # A boundary in front of a word character looks back, one behind it looks ahead.
            ahead = tokens[position + 1] if position + 1 < len(tokens) else ""
            starts_word = bool(re.match(r"[A-Za-z0-9_(]", ahead))
            out.append(f"(?<![{WORD}])" if starts_word else f"(?![{WORD}])")
        else:
            if token.startswith("["):
                in_class = True
            elif token == "]":
                in_class = False
            out.append(token)
    return "".join(out)


def any_of(patterns: Iterable[str]) -> str:
    """One alternation of several Python-dialect patterns."""
    return "|".join(jvm(p) for p in patterns)


_STARTS = re.compile(
    r"(?:\(\?<!\[\\w\.\]\)|\\b)?"  # (?<![\w.]) or \b in front, if any
    r"(?:\(((?:[A-Za-z0-9_]+\|)*[A-Za-z0-9_]+)\)(?![?*+{])"  # one of several words
    r"|((?:(?:[A-Za-z0-9_ \"=-]|\\\.)(?![?*+{]))+))"  # or one text
)


def branches(pattern: str) -> list[str]:
    """The alternatives of a Python-dialect pattern, cut at each ``|`` outside groups and classes."""
    if re.match(r"\(\?[A-Za-z]", pattern):  # flags in front hold for all of them
        return [pattern]
    found, depth = [""], 0
    for token in re.findall(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]|.", pattern, re.DOTALL):
        depth += (token == "(") - (token == ")")
        if token == "|" and depth == 0:
            found.append("")
        else:
            found[-1] += token
    return found


def starts(branch: str) -> list[str]:
    """Texts with one of which every match of a branch starts; none if they cannot be read off."""
    found = _STARTS.match(branch)
    if not found:
        return []
    return found[1].split("|") if found[1] else [found[2].replace("\\", "")]


def literal(text: str) -> str:
    """A pattern matching exactly ``text``."""
    return re.sub(r"([^\w\s])", r"\\\1", text, flags=re.ASCII)
