"""Fill-in-middle transformation: a wavelet matrix over character classes locates both cuts of a text.

1. The bytes of a text are put into classes: line ends, blanks, sentence stops, other characters, and the second to last bytes of
   a character. A wavelet matrix holds them as one bit vector per bit of the class; each vector knows the ones before every word
   of 64 bits, so ``rank`` (how many of a class come before a place) takes one look-up per bit and ``select`` (where the k-th of
   a class stands) one bisection per bit.
2. A unit ends behind a character of its closing classes, or at the end of the text. Ranks of these classes add up to the number
   of units that end before a place. One closing class is cut by ``select``, several by bisection on the sum of their ranks.
3. Hash words of ``seed:doc_id`` choose both cuts, whether the text is transformed, and its form. Characters are counted by ranks
   as well: places less the second to last bytes before them.

Output: ``plain`` the text; ``psm`` markers, prefix, suffix, middle; ``spm`` suffix, prefix, middle. Texts that are empty or hold a
marker stay plain, so every output can be undone.

Null texts count as empty, a null ``doc_id`` is hashed as no digits. Rows that repeat an id or a text are transformed each on their
own, ids alike. Texts of any length take memory in proportion to it: one byte for each of their own and two thirds of a byte for
the matrix. An empty table gives no rows. Added columns replace input columns of their names; all others stay.
"""

from __future__ import annotations

import hashlib
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import packed, small_batches, table, unpacked, whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50

OTHER, LINE_END, BLANK, STOP, INSIDE = range(5)
LEVELS = 3
#: The classes that close a unit.
UNITS = {"line": (LINE_END,), "sentence": (LINE_END, STOP), "word": (LINE_END, BLANK)}

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[list(b"\n")] = LINE_END
_CLASS[list(b" \t\x0b\x0c\r")] = BLANK
_CLASS[list(b".!?")] = STOP
_CLASS[0x80:0xC0] = INSIDE


class Bits:
    """A bit vector with the number of ones before each word of 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        self.n = len(bits)
        octets = np.packbits(bits, bitorder="little")
        self.words = np.zeros(self.n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(octets)] = octets
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])
        self.ones = int(self.before[-1])

    def rank(self, at: int) -> int:
        """Ones before the place."""
        word, bit = divmod(at, 64)
        return int(self.before[word]) + (int(self.words[word]) & ((1 << bit) - 1)).bit_count()

    def select(self, k: int, value: int) -> int:
        """Place of the k-th (from 0) bit of that value."""
        if value:
            word = int(np.searchsorted(self.before, k, "right")) - 1
            held, left = int(self.words[word]), k - int(self.before[word])
        else:  # zeros before each word
            low, high = 0, len(self.words) - 1
            while low < high:
                middle = (low + high + 1) // 2
                low, high = (middle, high) if 64 * middle - int(self.before[middle]) <= k else (low, middle - 1)
            word = low
            held, left = ~int(self.words[word]) & ((1 << 64) - 1), k - (64 * word - int(self.before[word]))
        for _ in range(left):
            held &= held - 1
        return 64 * word + (held & -held).bit_length() - 1


class WaveletMatrix:
    """Ranks and places of small symbols: at each level the sequence is split by one bit, zeros first, each part in its order."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS) -> None:
        self.n, self.levels = len(symbols), []
        for level in reversed(range(levels)):
            ones = (symbols >> level & 1).astype(bool)
            self.levels.append((level, Bits(ones)))
            if level:
                symbols = np.concatenate([symbols[~ones], symbols[ones]])

    def _first(self, symbol: int) -> tuple[int, list[int]]:
        """Where the run of the symbol starts below the last level, and its starts at each level."""
        start, starts = 0, []
        for level, bits in self.levels:
            starts.append(start)
            ones = bits.rank(start)
            start = self.n - bits.ones + ones if symbol >> level & 1 else start - ones
        return start, starts

    def rank(self, symbol: int, at: int) -> int:
        """How many of the symbol stand before the place."""
        start, _ = self._first(symbol)
        for level, bits in self.levels:
            ones = bits.rank(at)
            at = self.n - bits.ones + ones if symbol >> level & 1 else at - ones
        return at - start

    def select(self, symbol: int, k: int) -> int:
        """Where the k-th (from 0) of the symbol stands."""
        at = self._first(symbol)[0] + k
        for level, bits in reversed(self.levels):
            at = bits.select(at - (self.n - bits.ones), 1) if symbol >> level & 1 else bits.select(at, 0)
        return at


class Cutter:
    """Units and characters of one text."""

    def __init__(self, text: bytes, unit: str = "line") -> None:
        self.text, self.closing = text, UNITS[unit]
        self.matrix = WaveletMatrix(_CLASS[np.frombuffer(text, np.uint8)])
        self.closed = self.ends_before(len(text))
        self.units = self.closed + (len(text) > 0 and _CLASS[text[-1]] not in self.closing)

    def ends_before(self, at: int) -> int:
        return sum(self.matrix.rank(symbol, at) for symbol in self.closing)

    def cut(self, k: int) -> int:
        """The byte behind the first ``k`` units."""
        if k == 0:
            return 0
        if k > self.closed:
            return len(self.text)
        if len(self.closing) == 1:
            return self.matrix.select(self.closing[0], k - 1) + 1
        low, high = k, len(self.text)
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.ends_before(middle) >= k else (middle + 1, high)
        return low

    def characters(self, start: int, end: int) -> int:
        return end - start - (self.matrix.rank(INSIDE, end) - self.matrix.rank(INSIDE, start))


def _hash_words(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def _checked(markers: tuple[str, str, str]) -> list[bytes]:
    """The markers as bytes, if none can arise where a piece meets a marker."""
    found = [m.encode() for m in markers]
    for a in found:
        for b in found:
            if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)))):
                raise ValueError("markers must not be empty, hold or overlap one another")
    return found


def transformed(doc_id: Column, text: Column, unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, markers: tuple[str, str, str] = MARKERS) -> Column:
    """A struct ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` (null if plain) and ``output``.

    ``rate``: per cent of texts that are transformed; ``spm_rate``: per cent of those that are written suffix first.
    """
    prefix_mark, suffix_mark, middle_mark = _checked(markers)
    names = ["n", "form", "prefix_chars", "middle_chars", "output"]

    def one(doc_id: int | None, text: bytes) -> tuple:
        cutter, (h1, h2, h3, h4) = Cutter(text, unit), _hash_words(seed, doc_id)
        n = cutter.units
        if not text or h3 % 100 >= rate or any(m in text for m in (prefix_mark, suffix_mark, middle_mark)):
            return n, "plain", None, None, text
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        at, end = cutter.cut(first), cutter.cut(last)
        prefix, middle, suffix = prefix_mark + text[:at], middle_mark + text[at:end], suffix_mark + text[end:]
        form, output = ("spm", suffix + prefix + middle) if h4 % 100 < spm_rate else ("psm", prefix + suffix + middle)
        return n, form, cutter.characters(0, at), cutter.characters(at, end), output

    def batch(doc_ids: pa.Array, texts: pa.Array) -> pa.Array:
        made = [one(i, t) for i, t in zip(doc_ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        columns = [pa.array([row[i] for row in made], kind) for i, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays([*columns[:4], columns[4].cast(pa.string())], names)

    return F.arrow_udf(batch, "n long, form string, prefix_chars long, middle_chars long, output string")(doc_id.cast("long"), whole_text(text))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text again, from its output and form."""
    prefix_mark, suffix_mark, middle_mark = (F.lit(m) for m in markers)
    middle = F.split_part(output, middle_mark, F.lit(2))
    before = F.split_part(output, middle_mark, F.lit(1))
    psm = F.concat(F.split_part(F.split_part(before, suffix_mark, F.lit(1)), prefix_mark, F.lit(2)), middle, F.split_part(before, suffix_mark, F.lit(2)))
    spm = F.concat(F.split_part(before, prefix_mark, F.lit(2)), middle, F.split_part(F.split_part(before, prefix_mark, F.lit(1)), suffix_mark, F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(documents: DataFrame, **choices) -> DataFrame:
    """All columns of the documents, and ``n, form, prefix_chars, middle_chars, output``. Choices: those of ``transformed``."""
    small_batches(documents.sparkSession)
    rows = packed(documents).withColumn("made", transformed(F.col("row.doc_id"), F.col("row.text"), **choices)).select("row", "made.*")
    return unpacked(rows, "n", "form", "prefix_chars", "middle_chars", "output")


def op11_fim_transform(spark, sf_dir: str) -> DataFrame:
    """Every document cut into lines; digests of its output and of the text that the output gives back."""
    made = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda text: F.sha2(text, 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), listed AS (
  SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed
), cuts AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM listed
), pieces AS (
  SELECT *, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM pieces
"""
