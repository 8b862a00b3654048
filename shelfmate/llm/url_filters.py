"""URL filters by dated lists, with DataFrame functions only.

A list is a log of dated entries: on a day a pattern is added or removed. The log becomes validity intervals,
[valid_from, valid_to), and every capture is judged by the entries that were active when it was fetched:

- a capture's URL gives the keys that a pattern could have: the host and its parent domains, the host with each
  leading part of the path, and the URL itself;
- an as-of join brings keys and intervals together on (kind, key), keeping the interval that holds at
  the fetch time; a host that owns a third of all captures is split by adaptive execution;
- a capture is blocked if an active entry of a ``block`` list matches and none of an ``allow`` list.

Keys are only as deep as the deepest pattern of the lists, so long paths stay cheap and nothing is missed.

Defined results: a pattern added twice stays active until removed; of an addition and a removal on the same
day the removal holds. Entries with a null pattern, list or date are ignored. A capture with a null url or time, or a URL
without a host, matches nothing and is not blocked. Hosts compare in lower case, paths and URLs as written.
Repeated captures are judged each. Extra columns are ignored; empty tables give no rows or no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfmate.llm.common import read_table

#: The patterns of hosts and paths, shared with the SQL.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, kind, pattern, valid_from, valid_to) from (list, verdict, kind, pattern, action, dated)."""
    key = ["list", "verdict", "kind", "pattern"]
    days = (
        entries.dropna(subset=[*key, "dated", "action"])
        .groupBy(*key, "dated")
        .agg(F.min(F.when(F.col("action") == "add", F.lit(1)).otherwise(F.lit(0))).alias("_on"))
    )
    by_day = Window.partitionBy(*key).orderBy("dated")
    changes = days.withColumn("_before", F.coalesce(F.lag("_on").over(by_day), F.lit(0))).where("_on <> _before")
    ended = changes.withColumn("valid_to", F.lead("dated").over(by_day))
    return ended.where("_on = 1").select(*key, F.col("dated").alias("valid_from"), "valid_to")


def _depth(frame: DataFrame, kind: str, separator: str) -> int:
    n = F.max(F.size(F.split("pattern", separator)))
    return frame.where(F.col("kind") == kind).agg(n).first()[0] or 0


def candidate_keys(url: Column, labels: int, segments: int) -> Column:
    """array<struct<kind, key>> of everything a pattern of at most so many labels and segments could say."""
    host, path = host_of(url), path_of(url)
    parts = F.split(host, r"\.")
    n = F.least(F.size(parts), F.lit(labels))
    domains = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, -i, i), ".")))
    steps = F.split(path, "/")
    depth = F.least(F.size(steps), F.lit(segments))
    prefixes = F.when(
        depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda i: F.concat(host, F.array_join(F.slice(steps, F.lit(1), i), "/")))
    )
    of_kind = lambda kind, keys: F.transform(
        F.coalesce(keys, F.array().cast("array<string>")), lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("pattern"))
    )
    every = F.concat(of_kind("domain", domains), of_kind("prefix", prefixes), of_kind("url", F.array(url)))
    return F.when(F.length(host) > 0, every).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """One row per capture: key, url, host, fetched_at, n_active, lists, blocked."""
    valid = intervals(entries)
    labels, segments = _depth(entries, "domain", r"\."), _depth(entries, "prefix", "/")
    rows = captures.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(fetched).alias("_fetched"))
    rows = rows.groupBy("_key", "_url", "_fetched").agg(F.count(F.lit(1)).alias("_rows"))
    asked = rows.withColumn("_at", F.explode_outer(candidate_keys(F.col("_url"), labels, segments)))
    asked = asked.select("_key", "_url", "_fetched", "_rows", F.col("_at.kind").alias("kind"), F.col("_at.pattern").alias("pattern"))
    # The time belongs to the join: intervals that do not hold leave no rows. The hash makes skewed keys splittable, see joins.py.
    part = F.xxhash64("kind", "pattern")
    a, v = asked.withColumn("_part", part).alias("a"), valid.withColumn("_part", part).alias("v")
    then = (F.col("valid_from") <= F.col("_fetched")) & (F.col("valid_to").isNull() | (F.col("_fetched") < F.col("valid_to")))
    equal = [F.col(f"a.{c}") == F.col(f"v.{c}") for c in ("kind", "pattern", "_part")]
    met = a.join(v, equal[0] & equal[1] & equal[2] & then, "left")
    holds = F.col("valid_from").isNotNull()
    verdict = lambda v: F.max(F.when(holds & (F.col("verdict") == v), F.lit(1)).otherwise(F.lit(0)))
    judged = met.groupBy("_key", "_url", "_fetched", "_rows").agg(
        F.sum(holds.cast("long")).alias("n_active"),
        F.array_join(F.array_sort(F.collect_set(F.when(holds, F.col("list")))), ",").alias("lists"),
        ((verdict("block") == 1) & (verdict("allow") == 0)).alias("blocked"),
    )
    judged = judged.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    return judged.select(
        F.col("_key").alias(key), F.col("_url").alias(url), host_of(F.col("_url")).alias("host"),
        F.col("_fetched").alias(fetched), "n_active", "lists", "blocked",
    )


# --- the query: captures and a log of list entries, both derived from ``pages`` ---------

_DAY0 = "DATE'2024-01-01'"
_HASH = "CAST(conv(substring(md5(pattern), 1, 7), 16, 10) AS BIGINT)"


def page_captures(pages: DataFrame) -> DataFrame:
    """The table has no fetch times: a page's day follows from its id."""
    return pages.select("page_id", "url", F.expr(f"date_add({_DAY0}, CAST(pmod(page_id * 37, 366) AS INT))").alias("fetched_at"))


def page_list_entries(pages: DataFrame) -> DataFrame:
    """A log of list entries about the hosts and top folders that occur: which list, and when an entry came and
    went, follows from the MD5 of its pattern."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    folder = F.concat(host, F.lit("/"), F.get(F.split(path, "/"), 1))
    named = pages.select(host.alias("host"), folder.alias("folder")).where("length(host) > 0").distinct()
    pattern = F.explode(
        F.array(
            F.struct(F.lit("domain").alias("kind"), F.col("host").alias("pattern")),
            F.struct(F.lit("prefix").alias("kind"), F.col("folder").alias("pattern")),
        )
    )
    hashed = named.select(pattern.alias("p")).select("p.*").dropna().distinct().withColumn("h", F.expr(_HASH))
    lists = F.expr("CASE WHEN h % 5 = 0 THEN 'trusted' WHEN kind = 'domain' THEN 'hosts' ELSE 'folders' END").alias("list")
    verdict = F.expr("CASE WHEN h % 5 = 0 THEN 'allow' ELSE 'block' END").alias("verdict")
    events = F.expr(
        f"""explode(array(
        struct('add' AS action, date_add({_DAY0}, CAST(h % 120 AS INT)) AS dated),
        struct('remove' AS action, date_add({_DAY0}, CAST(130 + h % 50 AS INT)) AS dated),
        struct('add' AS action, date_add({_DAY0}, CAST(190 + h % 70 AS INT)) AS dated),
        struct('add' AS action, date_add({_DAY0}, CAST(265 + h % 90 AS INT)) AS dated)))"""
    ).alias("e")
    return hashed.where("h % 3 < 2").select(lists, verdict, "kind", "pattern", events).select("list", "verdict", "kind", "pattern", "e.*")


def query(spark, sf_dir):
    pages = read_table(spark, sf_dir, "pages")
    return judge(page_captures(pages), page_list_entries(pages))


ORACLE = rf"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '{HOST}', 1)) AS host, regexp_extract(url, '{PATH}', 1) AS path,
  CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched_at FROM pages),
p AS (SELECT 'domain' AS kind, host AS pattern FROM u WHERE host <> ''
  UNION SELECT 'prefix', host || '/' || split_part(path, '/', 2) FROM u WHERE host <> '' AND contains(path, '/')),
h AS (SELECT *, CAST('0x' || substr(md5(pattern), 1, 7) AS BIGINT) AS h FROM p),
l AS (SELECT *, CASE WHEN h % 5 = 0 THEN 'trusted' WHEN kind = 'domain' THEN 'hosts' ELSE 'folders' END AS list FROM h WHERE h % 3 < 2),
e AS (SELECT *, 1 AS active, DATE '2024-01-01' + CAST(h % 120 AS INTEGER) AS dated FROM l
  UNION ALL SELECT *, 0, DATE '2024-01-01' + CAST(130 + h % 50 AS INTEGER) FROM l
  UNION ALL SELECT *, 1, DATE '2024-01-01' + CAST(190 + h % 70 AS INTEGER) FROM l),
m AS (SELECT page_id, list, arg_max(active, dated) AS active FROM u JOIN e ON dated <= fetched_at AND host <> '' AND
  CASE WHEN kind = 'domain' THEN host = pattern OR ends_with(host, '.' || pattern)
    ELSE host || path = pattern OR starts_with(host || path, pattern || '/') END
  GROUP BY page_id, list, kind, pattern),
a AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
  bool_or(list <> 'trusted') AND NOT bool_or(list = 'trusted') AS blocked FROM m WHERE active = 1 GROUP BY page_id)
SELECT page_id, url, host, fetched_at, coalesce(n, 0) AS n_active, coalesce(lists, '') AS lists, coalesce(blocked, false) AS blocked
FROM u LEFT JOIN a USING (page_id)"""
