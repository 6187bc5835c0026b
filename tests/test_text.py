"""Lines, literals, blocks, taint and call sites against plain Python."""

import random
import re

from pyspark.sql import functions as F

from riskframe import rules
from riskframe.functions.patterns import jvm
from riskframe.functions.text import split_lines, strip_line_literals, strip_literals
from riskframe.operators import heuristics, lines, taint
from riskframe.operators.syntax import call_sites


def _random_texts(alphabet, n, length=24):
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(length))) for _ in range(n)]


def test_split_lines(spark):
    texts = _random_texts("ab\n\r\x0b\x0c\x1c\x1d\x1e\x85  ", 3000)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in rows.select("i", split_lines(F.col("t")).alias("l")).collect():
        assert r.l == texts[r.i].splitlines(), repr(texts[r.i])


def _literal_end(text, start, quote):
    """Where the literal that opens at ``start`` ends, or None if it is not closed."""
    if len(quote) == 3:
        end = text.find(quote, start + 3)
        return None if end < 0 else end + 3
    escaped = False
    for at in range(start + 1, len(text)):
        char = text[at]
        if escaped:
            if char == "\n":
                return None
            escaped = False
        elif char == quote:
            return at + 1
        else:
            escaped = char == "\\"
    return None


def _strip(text):
    """The text without its literals, found character by character, one kind of quote after the other."""
    for quote in ("'''", '"""', "'", '"'):
        out, at = [], 0
        while at < len(text):
            end = _literal_end(text, at, quote) if text.startswith(quote, at) else None
            if end is None:
                out.append(text[at])
            at = end or at + 1
        text = "".join(out)
    return text


def test_strip_literals(spark):
    texts = _random_texts("a'\"\\\n\r'\"", 4000)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(
        "i", strip_literals(F.col("t")).alias("whole"), F.split(strip_line_literals(F.col("t")), "\n", -1).alias("lines")
    )
    for r in rows.collect():
        assert r.whole == _strip(texts[r.i])
        assert r.lines == [_strip(line) for line in texts[r.i].split("\n")]


def test_long_literal_does_not_overflow(spark):
    rows = spark.createDataFrame([("x = '" + "a" * 300_000 + "' + 1",)], "t string")
    assert rows.select(strip_literals(F.col("t")).alias("t")).first().t == "x =  + 1"


def test_translated_patterns(spark):
    patterns = [r"(?<![\w.])eval\s*\(", r"\b(curl|wget)\b", r"\brequests?\.(get|post)\s*\(", r"\bsocket\b"]
    pieces = ["eval", "(", ".", " ", " ", "é", "curl", "wget", "request", "requests", ".get", "socket", "_", "1"]
    rng = random.Random(3)
    texts = ["".join(rng.choice(pieces) for _ in range(6)) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", *[F.col("t").rlike(jvm(p)).alias(f"p{k}") for k, p in enumerate(patterns)])
    for r in got.collect():
        for k, p in enumerate(patterns):
            assert r[f"p{k}"] == bool(re.search(p, texts[r.i])), (p, texts[r.i])


def _taint(text):
    """Least fixed point: an assignment is fed by a source, or by a name that an earlier fed assignment sets."""
    sets = [(line.split("=", 1)[0].strip(), line.lower()) for line in text.splitlines() if "=" in line]
    fed = {i for i, (_, low) in enumerate(sets) if "input(" in low}
    while True:
        more = {
            i for i, (_, low) in enumerate(sets)
            if {sets[j][0] for j in fed if j < i} & set(re.findall(r"\w+", low))
        }
        if more <= fed:
            break
        fed |= more
    return list(dict.fromkeys(sets[i][0] for i in sorted(fed)))


def test_taint_map(spark):
    rng = random.Random(5)
    names, values = ["a", "b", "Cap", "d_1"], ["input()", "1", "a + 1", "Cap", "b", "d_1.x", "xa"]
    texts = [
        "\n".join(f"{rng.choice(names)} = {rng.choice(values)}" for _ in range(rng.randrange(1, 8)))
        for _ in range(400)
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "file_id int, content string")
    got = {i: [] for i in range(len(texts))}
    for r in taint.taint_map(rows).orderBy("file_id", "pos").collect():
        got[r.file_id].append(r.variable)
    for i, text in enumerate(texts):
        assert got[i] == _taint(text), text


# Texts and the lines that stay, worked out by hand.
BLOCKS = [
    ("x\nSUSPICIOUS_PATTERNS = [\n  a\n]\ny", [1, 5]),
    ("SECRET_PATTERNS = [\n],\nx", [3]),
    ("explanations = {\n}\nx", [3]),
    ("DEPENDENCY_SEVERITY_POINTS = {\nx\n }\nz", [4]),
    ("DEPENDENCY_MANIFEST_FILES = {\n}\n", []),
    ("function loadSafeExample() {\n x\n}\ny", [4]),
    ("function loadSafeExample() {\n if {\n}\n}\ny", [5]),
    ("function loadSafeExample()\nx", [1, 2]),
    ("return { why_risky\n{\n}\n}\nx", [5]),
    ("return { why_risky }\nx\ny", [3]),
    ("return { other\nx", [1, 2]),
    ("SUSPICIOUS_PATTERNS = [\nx\ny", []),
    ("SUSPICIOUS_PATTERNS = [\nSECRET_PATTERNS = [\n]\nx\n]\ny", [6]),
    ("SUSPICIOUS_PATTERNS = [\nfunction loadSafeExample() {\n]\n}\n]\ny", [6]),
    (" y {\n}", [1, 2]),
    ("  SUSPICIOUS_PATTERNS = [\n ] \nz", [3]),
]


def test_excluded_blocks(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(BLOCKS)], "file_id int, content string")
    got = {i: [] for i in range(len(BLOCKS))}
    for r in lines.scannable_lines(rows).orderBy("file_id", "line_no").collect():
        got[r.file_id].append(r.line_no)
        assert BLOCKS[r.file_id][0].splitlines()[r.line_no - 1] == r.line
    for i, (text, kept) in enumerate(BLOCKS):
        assert got[i] == kept, text


def test_call_sites():
    show = lambda code: [(s["line"], s["pattern"], s["arg_kind"], s["arg_tainted"], s["fn_name"]) for s in call_sites(code)]
    assert show("not python (") == []
    assert show("def f():\n  def g():\n    eval(x)\n  exec('1')") == [
        (3, "eval(", "name", False, "g"), (4, "exec(", "literal", False, "f")]
    assert show("x: str = input()\neval(x)") == [(2, "eval(", "name", True, "")]
    assert show("eval(request.args.get('a'))\neval(request.json)") == [
        (1, "eval(", "other", False, ""), (2, "eval(", "other", True, "")]
    assert show("os.system(sys.argv[1])\nos.system(argv[1])\nos.system(os.environ['X'])") == [
        (1, "os.system", "other", False, ""), (2, "os.system", "other", True, ""), (3, "os.system", "other", True, "")]
    assert show("subprocess.run(f'{a}')\nsubprocess()\na.subprocess.run()") == [(1, "subprocess", "built", True, "")]
    assert show("urllib.request.Request()\nurlopen(x)") == [(1, "urllib.request.Request", "none", False, "")]
    assert show("eval(a - b)\neval(a + b)") == [(1, "eval(", "built", False, ""), (2, "eval(", "built", True, "")]


def test_gates_lose_no_match(spark):
    rng = random.Random(12)
    pieces = sorted({w for words in [*rules.SIGNAL_WORDS.values(), *rules.TOUCH_WORDS.values()] for w in words}) + [
        "get", "post(", "(", " (", "s(", "b64decode(", "://", "s://", ".", " ", "x", "urlopen", "\n", "import_module(", "loads(",
    ]
    texts = ["".join(rng.choices(pieces, k=6)) for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    named = [(n, p, rules.SIGNAL_WORDS[n]) for n, p in rules.SIGNALS.items()] + [(n, p, rules.TOUCH_WORDS[n]) for n, p in rules.TOUCHES]
    got = rows.select("i", *[heuristics.matches(F.col("t"), p, words).alias(f"c{k}") for k, (_, p, words) in enumerate(named)]).collect()
    for r in got:
        for k, (name, pattern, _) in enumerate(named):
            assert r[f"c{k}"] == bool(re.search(pattern, texts[r.i])), (name, texts[r.i])
