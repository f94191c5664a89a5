"""URL rules by a sort-merge range join.

A host's labels in reverse order make a key in which all subdomains of a rule's host follow it
without a gap: the rule is an interval. Urls and rules sorted by that key are swept once, with a
stack of the rules whose intervals are open. Each open rule then asks whether the path begins with
its own.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headcount.llm.shared import table, with_field

#: Rows of the sample that the borders of the partitions come from, for each partition.
SAMPLE = 32
#: Ends an interval: no key holds it.
LAST = "\U0010ffff"


def _lower(host):
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url) -> tuple:
    """Columns for the host (A-Z lower-cased) and the path of a url; both empty without ``://``."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = _lower(F.regexp_extract(after, r"^[^/?#]*", 0))
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _key(host):
    """The reversed host as a column; an empty host sorts before all others."""
    labels = F.array_join(F.reverse(F.split(host, r"\.", -1)), ".")
    return F.when(host == "", "").otherwise(F.concat(labels, F.lit(".")))


class Open:
    """The stack of open rules. A rule's key begins with the key of the rule below it."""

    def __init__(self, default: str):
        self.stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []
        self.default = default

    def close(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def rule(self, key: str, path: str, name: str, verdict: str) -> None:
        self.close(key)
        if not self.stack or self.stack[-1][0] != key:
            self.stack.append((key, {}, []))
        _, own, sizes = self.stack[-1]
        if path not in own or verdict < own[path][1]:
            own[path] = (name, verdict)
        if len(path) not in sizes:
            sizes.append(len(path))
            sizes.sort(reverse=True)

    def judge(self, key: str, path: str) -> tuple[str | None, str]:
        """The longest fitting rule and its verdict; of equally long ones that of the deeper host."""
        self.close(key)
        best: tuple[str | None, str] = (None, self.default)
        for _, own, sizes in reversed(self.stack):
            for n in sizes:
                if n <= len(path) and (found := own.get(path[:n])):
                    if best[0] is None or len(found[0]) > len(best[0]):
                        best = found
                    break
        return best


def _sweep(default: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, part = Open(default), None
        for batch in batches:
            at = {n: batch.column(n).to_pylist() for n in ("__part", "__key", "__order", "__path", "__rule", "__verdict")}
            kept, out = [], []
            for i, (p, key, order, path, name, verdict) in enumerate(zip(*at.values())):
                if p != part:
                    rules, part = Open(default), p
                if order == 0:
                    rules.rule(key, path, name, verdict)
                else:
                    kept.append(i)
                    out.append(rules.judge(key, path))
            rows = batch.select(names).take(pa.array(kept, pa.int64()))
            made = [pa.array([x[k] for x in out], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*names, "rule", "verdict"])

    return run


def filter_urls(df: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """df with ``host``, ``path``, ``rule`` and ``verdict`` per row; these replace columns of those names.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains if
    the path begins with its own; the longest wins, the first verdict of the alphabet if one rule is
    there twice. Without a fitting rule, ``rule`` is null and the verdict is ``default``.

    Partitions are ranges of (key, row's hash), with borders from a sample that grows with the number
    of partitions only, so the rows of a host that has a third of them spread over many. A rule goes
    to the partitions that its interval meets.
    """
    made = ("host", "path", "rule", "verdict")
    names = [c for c in df.columns if c not in made]
    host, path = parts(F.col(f"`{url}`"))
    rows = df.select(*[F.col(f"`{c}`") for c in names], host.alias("host"), path.alias("path"))
    rows = rows.withColumn("__key", _key(F.col("host"))).withColumn("__salt", F.xxhash64(F.col(f"`{key}`"), url))
    wide = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(rows, wide)

    @F.pandas_udf("int")
    def spots(keys: pd.Series, salts: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(borders, p) for p in zip(keys, salts)], dtype="int32")

    urls = rows.select(
        spots("__key", "__salt").alias("__part"), "__key", F.lit(1).alias("__order"), F.col("path").alias("__path"),
        F.lit(None).cast("string").alias("__rule"), F.lit(None).cast("string").alias("__verdict"),
        *[F.col(f"`{c}`") for c in names], "host", "path",
    )
    low = F.lit(-(1 << 63))
    spans = rules.select(
        _key(_lower(F.coalesce("host", F.lit("")))).alias("__key"), F.coalesce("path", F.lit("")).alias("__path"),
        F.concat(F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))).alias("__rule"), F.col("verdict").alias("__verdict"),
    )
    spans = spans.withColumn("__first", spots("__key", low)).withColumn(
        "__last", spots(F.concat("__key", F.lit(LAST)), low)
    )
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in urls.schema.fields[6:]]
    opened = spans.select(
        F.explode(F.sequence("__first", "__last")).alias("__part"), "__key", F.lit(0).alias("__order"), "__path", "__rule", "__verdict", *empty
    )
    schema = with_field(urls.select(*[F.col(f"`{c}`") for c in [*names, "host", "path"]]), ("rule", "string"), ("verdict", "string"))
    return (
        urls.unionByName(opened)
        .repartitionById(wide, F.col("__part"))
        .sortWithinPartitions("__part", "__key", "__order")
        .mapInArrow(_sweep(default, [*names, "host", "path"]), schema)
    )


def _borders(rows: DataFrame, wide: int) -> list[tuple[str, int]]:
    """At most ``wide - 1`` borders, from the rows with the smallest hashes: a bounded uniform sample.

    Rows are counted first, so that the hash decides about each by itself and none are sorted.
    """
    share = wide * SAMPLE / max(rows.count(), 1)
    few = F.pmod(F.xxhash64("__salt", F.lit(3)), F.lit(1 << 31)) < min(int(share * (1 << 31)), 1 << 31)
    sample = rows.select("__key", "__salt").where(few).limit(4 * wide * SAMPLE).collect()
    pairs = sorted((r["__key"], r["__salt"]) for r in sample)
    return [pairs[len(pairs) * i // wide] for i in range(1, wide)] if len(pairs) >= wide else []


#: Fixed values of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLE_OP7 = r"""
WITH a AS (
  SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1, 's') AS rest FROM pages
),
p AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM a
),
r(h, s, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (
  SELECT page_id, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict
  FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
