"""Toxicity, chat, neighbours and url rules against plain versions."""

import math
import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from riskframe.llm import ann, chat, toxicity, url_rules
from tests.llm.brute import documents

BAD = ["grub", "snarl", "vile"]


def _labelled(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulmnrst") for _ in range(5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        text = [rng.choice(plain) for _ in range(rng.randrange(5, 200))]
        for _ in range(rng.randrange(1, 8) if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD).upper())
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_texts(spark):
    rows, labels = _labelled(600, 1)
    train = spark.createDataFrame([x for x in labels if x[0] % 2] + [x for x in labels if x[0] % 2][:9] + [(None, 1, 1), (3, None, None), (10**9, 0, 1)], "doc_id long, quality int, toxic int")
    table = documents(spark, [*rows, (9001, None), (9002, "")])
    got = {r["doc_id"]: r for r in toxicity.toxicity(table, train).collect()}
    held = [x for x in labels if x[0] % 2 == 0]
    assert sum(got[i]["toxic"] == bool(t) for i, _, t in held) / len(held) > 0.98
    assert not got[9001]["toxic"] and not got[9002]["toxic"]
    severity = [np.mean([got[i]["severity"] for i, _, t in held if t == k]) for k in (0, 1)]
    assert severity[0] < 0.2 < 0.8 < severity[1] <= toxicity.GRADES - 1
    kept = toxicity.clean_documents(table, train)
    assert kept.columns == table.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["toxic"]}


def test_toxicity_without_labels(spark):
    table = documents(spark, [(1, "grub"), (1, "grub"), (None, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [(r["severity"], r["toxic"]) for r in toxicity.toxicity(table, none).collect()] == [(0.0, False)] * 3
    assert toxicity.toxicity(documents(spark, []), none).count() == 0


def test_ordinal_fit_orders_thresholds_and_finds_weights():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3)) < 0.5
    latent = x @ np.array([2.0, -1.5, 0.0]) + rng.logistic(size=4000)
    grades = np.searchsorted([-1.0, 0.5, 2.0], latent)
    rows, columns = np.nonzero(x)
    weights, cuts = toxicity.fit_ordinal(rows, columns, 3, grades, 4, penalty=0.1)
    assert np.allclose(weights, [2.0, -1.5, 0.0], atol=0.25) and np.allclose(cuts, [-1.0, 0.5, 2.0], atol=0.25)


def _chats(seed):
    rng = random.Random(seed)
    rows, conv = [], 0
    for _ in range(15):
        turns = [("user" if i % 2 == 0 else "assistant", rng.choice("abc")) for i in range(rng.randrange(1, 7))]
        for _ in range(3):
            for place, (role, text) in enumerate(turns[: rng.randrange(1, len(turns) + 1)]):
                rows.append((conv, place, role, text))
            conv += 1
    return rows + rows[:5] + [(None, None, None, None), (None, 0, "user", "zz"), (conv, None, "", ""), (conv + 1, 3, "user", None), (conv + 1, 3, "user", "")]


def test_chats(spark):
    for rows in (_chats(1), []):
        got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
        groups = {}
        for conv, turn, role, text in set(rows):
            groups.setdefault(conv, set()).add((turn is not None, turn or 0, role or "", text or ""))
        logged = {conv: [t[2:] for t in sorted(turns)] for conv, turns in groups.items()}
        want = set()
        for conv, turns in logged.items():
            same = [c for c, other in logged.items() if other == turns]
            longer = any(len(other) > len(turns) and other[: len(turns)] == turns for other in logged.values())
            if not longer and conv == min(same, key=lambda c: (c is None, c or 0)):
                want |= {(conv, len(turns), len(same), i + 1, f"<|{role}|>\n{text}<|end|>\n") for i, (role, text) in enumerate(turns)}
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def _vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.standard_normal(dim)], 1) for i in range(n)]
    copy = rows[7][1]
    return rows + [(n + i, copy, 1) for i in range(30)] + [(2000, None, 1), (2001, [0.0] * dim, 1), (2002, [math.nan] * dim, 1), (2003, [1.0] * (dim + 1), 1), (2004, [], 1), (None, copy, 1), (7, copy, 1)]


def test_neighbours_recall_and_scores(spark):
    rows = _vectors(900, 16, 3)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.search(table, F.col("vec_id") % 20 == 7, share=0.7, slice_rows=200, query_rows=10).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    valid = {i: np.array(v) for i, v, _ in rows if i is not None and v and len(v) == 16 and np.isfinite(v).all() and any(v)}
    queries = [i for i in valid if i % 20 == 7]
    assert set(got) == set(queries)
    hits = 0
    for q in queries:
        scores = sorted((-float(valid[q] @ v / np.linalg.norm(valid[q]) / np.linalg.norm(v)), i) for i, v in valid.items() if i != q)
        best = {i for _, i in scores[:5]}
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        assert all(abs(-dict((i, s) for s, i in scores)[i] - s) < 1e-12 for i, s in got[q].values())
        assert [got[q][k] for k in range(1, 6)] == sorted(got[q].values(), key=lambda x: (-x[1], x[0]))
        hits += len(best & {i for i, _ in got[q].values()})
    assert hits / (5 * len(queries)) >= 0.9
    assert [got[7][k][0] for k in range(1, 6)] == [900, 901, 902, 903, 904]


def test_neighbours_of_few_vectors(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.search(table([]), F.col("vec_id") == 0).count() == 0
    assert ann.search(table([(0, [1.0, 2.0])]), F.col("vec_id") == 0).count() == 0
    got = ann.search(table([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [4.0, 0.0]), (2, [0.0, 1.0])]), F.col("vec_id") == 0).collect()
    assert [tuple(r) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 2, 0.0)]


URLS = [None, "", "nothing", "http://Example.ORG/es/a", "http://a.example.org/en/1x", "https://example.org/en/2", "http://org", "http://org/", "x://y://z/p", "http://b.com/fr/1?x=/de/", "http://b.com/de/#a", "http://com/de/", "http://xcom/de/", "http://b.com/de", "http://É.net/a\nb", "//no", "http://?q"]


def _plain_host_path(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[end:]
    cut = min([path.find(c) for c in "?#" if c in path], default=len(path))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:cut]


def test_url_parts_and_rules(spark):
    rows = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")).collect()}
    for i, url in enumerate(URLS):
        host, path = _plain_host_path(url)
        fits = [(h + p, v) for h, p, v in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"]) == (host, path, rule[0]), url
        assert rows[i]["verdict"] == (rule[1] or rows[i]["verdict"])


def test_mined_rules_are_those_of_counting(spark):
    rng = random.Random(5)
    known = []
    for _ in range(300):
        bad = rng.random() < 0.4
        parts = [rng.choice(["news", "shop", "blog"]), "ads" if bad and rng.random() < 0.9 else rng.choice(["home", "ads", "faq"]), rng.choice("xyz")]
        known.append((f"http://h{rng.randrange(3)}.net/{'/'.join(parts)}/{rng.randrange(10**6)}", "block" if bad else "allow"))
    labelled = spark.createDataFrame(known, "url string, verdict string")
    rows = labelled.select(url_rules.tokens_of(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("tokens"), "verdict")
    mined = {(tuple(r["tokens"]), r["verdict"]): (r["confidence"], r["support"]) for r in url_rules.mine(rows, 0.05, 0.8).collect()}
    baskets = {(tuple(r["tokens"]), r["verdict"]) for r in rows.collect()}
    n, base = len(baskets), sum(v == "block" for _, v in baskets) / len(baskets)
    counts = {}
    for tokens, verdict in baskets:
        for t in tokens:
            c = counts.setdefault(t, [0, 0])
            c[0] += 1
            c[1] += verdict == "block"
    items = sorted((t for t, c in counts.items() if c[0] >= 0.05 * n), key=lambda t: (-abs(counts[t][1] - counts[t][0] * base), t))[: url_rules.MAX_ITEMS]
    found = {}
    for size in range(1, len(items) + 1):
        for chosen in combinations(sorted(items), size):
            held = [v for t, v in baskets if set(chosen) <= set(t)]
            for verdict in ("allow", "block"):
                k = held.count(verdict)
                if k >= 0.05 * n and k >= 0.8 * len(held):
                    found[chosen, verdict] = (k / len(held), k / n)
        if size == 4:
            break
    want = {key: v for key, v in found.items() if not any((tuple(x for x in key[0] if x != t), key[1]) in found and found[tuple(x for x in key[0] if x != t), key[1]][0] >= v[0] for t in key[0])}
    assert want and {k: tuple(round(x, 9) for x in v) for k, v in mined.items() if len(k[0]) <= 4} == {k: tuple(round(x, 9) for x in v) for k, v in want.items()}
    urls = [u for u, _ in known] + ["http://other.io/"]
    tokens = {r["url"]: set(r["tokens"]) for r in spark.createDataFrame([(u,) for u in urls], "url string").select("url", url_rules.tokens_of(url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))).alias("tokens")).collect()}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_rules.judge(pages, rules=(), labelled=labelled, min_support=0.05).collect()}
    fitted = 0
    for i, url in enumerate(urls):
        fits = [((-c, -s, -len(t), t), v) for (t, v), (c, s) in mined.items() if set(t) <= tokens[url]]
        best = min(fits, default=((None,), "allow"))
        assert got[i]["verdict"] == best[1] and got[i]["confidence"] == (best[0][0] and -best[0][0])
        fitted += bool(fits)
    assert 0 < fitted < len(urls)
