"""URL filters by a sort-merge range join on reversed-host keys.

A host becomes the key of its labels in reverse, each followed by ``/`` (which no host can contain):
``a.example.org`` is ``org/example/a/``. "This host and its subdomains" is then the interval of keys that
start with the rule's key. URLs are range-partitioned and sorted by (key, path, id); each task sweeps its
slice once, beside the sorted rules, with a stack of the nested intervals that hold the current key. A hot
host is split over tasks, since path and id are part of the sort key.

Rules are broadcast only while they are fewer than ``max_broadcast_rules``; more of them are matched by an
equi-join on the suffixes of each host, whose number is that of its labels.

Defined cases: null url or one without ``://`` has an empty host and path and fits no rule; rules with null
host or path are ignored; of equal rules, ``block`` wins; equally long rules that fit: the longer host wins; ids may be null, repeated and of any type that
has an order; a very long url is one row like others; an empty table gives one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm.common import table

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://; empty for null or without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "/"), F.lit("/"))


class _Rules:
    """Rules of a sorted list of keys, and the best rule of a key for a path."""

    def __init__(self, rows: list[tuple[str, str, str, str]]):
        """rows: key, host, path, verdict."""
        by: dict[str, dict[str, tuple[int, int, str, str]]] = {}
        for key, host, path, verdict in sorted(rows, key=lambda r: r[3] != "allow"):  # of equal rules, block comes last and stays
            by.setdefault(key, {})[path] = (len(host) + len(path), len(host), host + path, verdict)
        self.keys = sorted(by)
        self.paths = [by[k] for k in self.keys]
        self.lengths = [sorted({len(p) for p in by[k]}, reverse=True) for k in self.keys]

    def best(self, at: int, path: str):
        own = self.paths[at]
        for n in self.lengths[at]:
            if n <= len(path) and (hit := own.get(path[:n])):
                return hit
        return None


def _sweep(rules: _Rules, default: str, id_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, stack, at, last = rules.keys, [], 0, None
        for b in batches:
            names, verdicts = [], []
            for key, path in zip(b["__key"], b["path"], strict=True):
                if key != last:
                    while at < len(keys) and keys[at] <= key:
                        while stack and not keys[at].startswith(keys[stack[-1]]):
                            stack.pop()
                        stack.append(at)
                        at += 1
                    while stack and not key.startswith(keys[stack[-1]]):
                        stack.pop()
                    last = key
                hit = max((h for i in stack if (h := rules.best(i, path))), default=None)
                names.append(hit and hit[2])
                verdicts.append(hit[3] if hit else default)
            yield pd.DataFrame({id_col: b[id_col], "host": b["host"], "path": b["path"], "rule": pd.Series(names, dtype=object), "verdict": verdicts})

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_broadcast_rules: int = 100_000) -> DataFrame:
    """rules: verdict, host, path. Returns id_col, host, path, rule, verdict, a row for each row of pages."""
    kind = pages.schema[id_col].dataType.simpleString()
    urls = pages.select(id_col, F.col(url_col).alias("url"))
    urls = urls.select(id_col, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("__key", key_of(F.col("host")))
    rules = rules.where("host is not null and path is not null").select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path")
    head = rules.withColumn("k", key_of(F.col("host"))).select("k", "host", "path", "verdict").limit(max_broadcast_rules + 1).collect()
    if len(head) <= max_broadcast_rules:
        n = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        swept = urls.repartitionByRange(n, "__key", "path", id_col).sortWithinPartitions("__key", "path", id_col)
        return swept.mapInPandas(_sweep(_Rules([tuple(r) for r in head]), default, id_col), f"{id_col} {kind}, host string, path string, rule string, verdict string")
    return match_by_join(urls, rules, id_col, default)


def match_by_join(urls: DataFrame, rules: DataFrame, id_col: str, default: str) -> DataFrame:
    """The way for rules beyond the bound: distinct (host, path) meet the rules of every suffix of the host."""
    hosts = urls.select("host", "path").distinct()
    labels = hosts.withColumn("l", F.split("host", r"\.", -1)).select("host", "path", F.explode(F.expr("transform(sequence(1, size(l)), i -> array_join(slice(l, i, size(l)), '.'))")).alias("suffix"))
    r = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
    fits = labels.join(r, (F.col("suffix") == F.col("r_host")) & F.expr("startswith(path, r_path)"))
    order = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.concat("r_host", "r_path").alias("rule"), F.col("verdict").alias("v"))
    best = fits.groupBy("host", "path").agg(F.max(order).alias("b")).select(F.col("host").alias("h"), F.col("path").alias("p"), "b")
    return urls.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(id_col, "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.v", F.lit(default)).alias("verdict"))


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), rules_table(spark))


OP10_SQL = """
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT h.page_id, rhost || rpath AS rule, verdict,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) AS k
      FROM h JOIN r ON (h.host = rhost OR ends_with(h.host, '.' || rhost)) AND starts_with(h.path, rpath))
SELECT h.page_id, h.host, h.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id AND m.k = 1
"""
