"""Contexts of personal data without digits."""

from riskframe.llm import pii
from tests.llm.brute import documents


def test_identifiers_without_digits_are_found(spark):
    names = [a + b for a in ("jane", "omar", "lena", "ivo", "ruth") for b in ("doe", "fox", "ray", "lee")]
    known = [(i, f"please mail customer {n}@example.org today and go on") for i, n in enumerate(names)]
    other = [(200, "so mail customer (jane-at-example), today"), (201, "so mail customer jane-at-example today"), (202, "nothing to see"), (203, "mail customer - today")]
    rows = {r["doc_id"]: r for r in pii.digest(documents(spark, [*known, *other])).collect()}
    assert rows[201]["spans"] == "context:17:32" and rows[200]["spans"] == "context:18:33"
    assert rows[202]["spans"] == rows[203]["spans"] == ""
    assert all(rows[i]["spans"] == f"email:21:{33 + len(n)}" for i, n in enumerate(names))
