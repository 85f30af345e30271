"""URL filtering against lists that change over time, with DataFrame operations only.

Dated additions and removals of patterns become validity intervals; each
capture is judged by the entries that were active when it was fetched. A
pattern is a host (with all its subdomains) or ``host/directory``. Captures are
reduced to their distinct (host, directory, day) before the as-of join, so a
host with very many captures costs it one row a day.

Edge cases: a null or unparsable url has an empty host and matches nothing; a
null fetch day matches no interval; entries with a null pattern, day or action
are void; at equal days a removal wins over an addition; repeated entries are
one; repeated captures get a verdict each; extra columns are not read; empty
tables give empty or unmatched results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
DIRECTORY = r"^[a-z][a-z0-9+.-]*://[^/?#]+/([^/?#]+)"

#: The lists of the registered query: list, pattern, action, day.
ENTRIES = [
    ("spam", "spam-farm.example.org", "add", "2024-01-10"),
    ("spam", "spam-farm.example.org", "remove", "2024-05-01"),
    ("spam", "spam-farm.example.org", "add", "2024-08-15"),
    ("pharma", "cheap-pills.example.com", "add", "2023-11-01"),
    ("spam", "cheap-pills.example.com", "add", "2024-03-01"),
    ("spam", "cheap-pills.example.com", "remove", "2024-04-01"),
    ("malware", "tionsh.example.net", "add", "2024-02-01"),
    ("malware", "tionsh.example.net", "remove", "2024-02-15"),
    ("malware", "tionsh.example.net", "add", "2024-06-20"),
    ("malware", "tionsh.example.net", "remove", "2024-07-20"),
    ("adult", "ththre.example.com", "add", "2024-03-10"),
    ("adult", "tionble.example.com", "add", "2024-04-04"),
    ("adult", "tionble.example.com", "remove", "2024-10-04"),
    ("phishing", "blog.ththth.example.org", "add", "2024-01-01"),
    ("phishing", "thther.example.org/fr", "add", "2024-01-15"),
    ("phishing", "m.thther.example.org/de", "add", "2024-05-05"),
    ("phishing", "ththon.example.com/en", "add", "2024-09-01"),
    ("phishing", "ththon.example.com/en", "remove", "2024-09-01"),
]
FIRST_DAY = "2024-01-01"
DAYS = 366


def intervals(entries: DataFrame) -> DataFrame:
    """(list, pattern, since, until) from (list, pattern, action, day): until is the next entry's day, or null."""
    sound = entries.where("pattern IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')").select("list", F.lower("pattern").alias("pattern"), "action", "day").distinct()
    later = Window.partitionBy("list", "pattern").orderBy("day", "action")
    return sound.withColumn("until", F.lead("day").over(later)).where("action = 'add'").select("list", "pattern", F.col("day").alias("since"), "until")


def url_verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched, n_active, lists and blocked of every row of ``captures`` (page_id, url, fetched date)."""
    url = F.lower("url")
    rows = captures.select(
        "page_id", F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")).alias("host"), F.coalesce(F.regexp_extract(url, DIRECTORY, 1), F.lit("")).alias("directory"), "fetched"
    )
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    keys = F.explode(F.concat(suffixes, F.transform(suffixes, lambda s: F.concat(s, F.lit("/"), F.col("directory")))))
    asked = rows.where("fetched IS NOT NULL AND host <> ''").select("host", "directory", "fetched").distinct().select("*", keys.alias("pattern"))
    active = asked.join(intervals(entries), "pattern").where("since <= fetched AND (until IS NULL OR fetched < until)")
    verdict = active.groupBy("host", "directory", "fetched").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("list")), ",").alias("l"))
    return rows.join(verdict, ["host", "directory", "fetched"], "left").select(
        "page_id", "host", F.col("fetched").cast("string").alias("fetched"), F.coalesce("n", F.lit(0)).cast("long").alias("n_active"), F.coalesce("l", F.lit("")).alias("lists"), F.col("n").isNotNull().alias("blocked")
    )


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages``; the table has no fetch time, so page n counts as fetched on day n mod DAYS of the year."""
    entries = spark.createDataFrame(ENTRIES, "list string, pattern string, action string, day string").withColumn("day", F.to_date("day"))
    pages = read(spark, sf_dir, "pages").select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int")).alias("fetched"))
    return url_verdicts(pages, entries)


def _oracle() -> str:
    values = ", ".join(f"('{a}', '{b}', '{c}', DATE '{d}')" for a, b, c, d in ENTRIES)
    return f"""
WITH e(list, pattern, action, day) AS (VALUES {values}),
i AS (SELECT list, pattern, action, day AS since, lead(day) OVER (PARTITION BY list, pattern ORDER BY day, action) AS until FROM (SELECT DISTINCT * FROM e)),
p AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '{HOST}', 1), '') AS host, coalesce(regexp_extract(lower(url), '{DIRECTORY}', 1), '') AS directory,
    DATE '{FIRST_DAY}' + ((page_id % {DAYS} + {DAYS}) % {DAYS})::INTEGER AS fetched, row_number() OVER () AS row
  FROM pages
), k AS (
  SELECT p.*, unnest([array_to_string(string_split(host, '.')[j:], '.') FOR j IN range(1, len(string_split(host, '.')) + 1)]) AS suffix FROM p
), m AS (
  SELECT k.row, i.list FROM k JOIN i ON i.action = 'add' AND i.since <= k.fetched AND (i.until IS NULL OR k.fetched < i.until) AND (i.pattern = k.suffix OR i.pattern = k.suffix || '/' || k.directory)
), v AS (SELECT row, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS l FROM m GROUP BY row)
SELECT page_id, host, fetched::VARCHAR AS fetched, coalesce(n, 0)::BIGINT AS n_active, coalesce(l, '') AS lists, n IS NOT NULL AS blocked FROM p LEFT JOIN v USING (row)
"""


OP6_SQL = _oracle()
