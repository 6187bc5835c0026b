"""Plain versions to compare with."""

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, kept string"


def documents(spark, rows):
    """A documents table of ``(doc_id, text)`` or ``(doc_id, text, source)``, with extra columns whose names clash with results."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1]), "own", "own") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(sets, percent):
    """Smallest linked index for each of the sets."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def _matches(pattern, text, ok):
    return [m.span() for m in re.finditer(pattern, text) if ok(m)]


def _luhn(value):
    digits = [int(c) for c in re.sub("[ -]", "", value)]
    if not 13 <= len(digits) <= 19:
        return False
    total = 0
    for place, digit in enumerate(reversed(digits)):
        digit = digit * 2 if place % 2 else digit
        total += digit - 9 if digit > 9 else digit
    return total % 10 == 0


def personal(text):
    """``kind -> spans`` of the fixed forms of personal data."""
    return {
        "email": _matches(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text, lambda m: True),
        "ip": _matches(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text, lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": _matches(r"[0-9]([\x20-]?[0-9])+", text, lambda m: _luhn(m[0])),
        "phone": _matches(r"\+[0-9][\x20().0-9-]+[0-9]", text, lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
    }


def secrets(text):
    """``(start, kind order, kind, end)`` of the fixed forms of secrets, sorted."""
    assign = r"""(?a:(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)))"""
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 12]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(found)
