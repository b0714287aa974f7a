"""Differences between two sessions, and set operations on what assets name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.operators.dedup import key_of
from quarrylight.operators.normalize import is_ip


def keyed(assets: DataFrame, strategy: str = "smart") -> DataFrame:
    """Each key's first row."""
    named = assets.withColumn("key", key_of(strategy)).where("key IS NOT NULL")
    first = named.groupBy("key").agg(F.min_by(F.struct(*[F.col(c) for c in assets.columns]), "seq").alias("_row"))
    return first.select("key", "_row.*")


def changes(before: DataFrame, after: DataFrame, strategy: str = "smart") -> DataFrame:
    """(key, change): 'added', 'removed' or 'common', by one full outer join of the distinct keys."""
    a = before.select(key_of(strategy).alias("key")).where("key IS NOT NULL").distinct().withColumn("_a", F.lit(1))
    b = after.select(key_of(strategy).alias("key")).where("key IS NOT NULL").distinct().withColumn("_b", F.lit(1))
    both = a.join(b, "key", "full_outer")
    return both.select("key", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("common").alias("change"))


def change_summary(before: DataFrame, after: DataFrame, sample: int = 500, strategy: str = "smart") -> DataFrame:
    """One row: totals, keyed counts, common, added, removed and whether a sample of ``sample`` keys would be cut."""
    counts = changes(before, after, strategy).agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("common", "added", "removed")])
    totals = before.agg(F.count("*").alias("total_a")).crossJoin(after.agg(F.count("*").alias("total_b")))  # one row each
    out = totals.crossJoin(counts)
    return out.select(
        "total_a", "total_b", (F.col("common") + F.col("removed")).alias("keyed_a"), (F.col("common") + F.col("added")).alias("keyed_b"),
        "common", "added", "removed", (F.col("added") > sample).alias("added_truncated"), (F.col("removed") > sample).alias("removed_truncated"),
    )


def change_sample(before: DataFrame, after: DataFrame, change: str, most: int = 500, strategy: str = "smart") -> DataFrame:
    """The first ``most`` added or removed assets by key."""
    keys = changes(before, after, strategy).where(F.col("change") == change).select("key")
    return keyed(after if change == "added" else before, strategy).join(keys, "key", "left_semi").orderBy("key").limit(most)


def bag_union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def set_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def set_minus(a: Column, b: Column) -> Column:
    return F.array_except(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def merged_candidates(rows: DataFrame) -> DataFrame:
    """Candidates (source, label, ips) with equal source and label as one, addresses unioned."""
    return rows.groupBy("source", "label").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("ips")))).alias("ips"))


def pivots(assets: DataFrame, root) -> DataFrame:
    """Distinct (kind, value) of hosts, roots, ips and urls that assets name, without ports and wildcards. ``root``: host column to its registrable domain."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r"^\*\.", ""), r"^([^:]+):\d+$", "$1")
    names = F.array_compact(F.concat(F.array("host", "domain"), F.coalesce("cert_domains", F.array().cast("array<string>"))))
    hosts = assets.select(F.explode(names).alias("n")).select(bare(F.col("n")).alias("value")).where("value <> ''").distinct()
    literal = is_ip(F.col("value"))
    of_hosts = hosts.select(F.when(literal, "ip").otherwise("host").alias("kind"), "value")
    roots = hosts.where(~literal).select(F.lit("root").alias("kind"), root(F.col("value")).alias("value"))
    ips = assets.select(F.lit("ip").alias("kind"), F.col("ip").alias("value"))
    urls = assets.select(F.lit("url").alias("kind"), F.col("url").alias("value"))
    return of_hosts.union(roots).union(ips).union(urls).where("value IS NOT NULL").distinct()
