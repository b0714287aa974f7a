"""Keyed merge of duplicate assets.

Rows with a null key go and are counted. Merging keeps each scalar's first value by ``seq``, unions lists, joins sources in
order with ``+`` (repeats stay; ``source_set`` has them once), and lets the last ``raw`` value of each name win. One
shuffle of rows on the key, and one of the distinct elements of lists and entries of ``raw``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.model import LISTS, SCALARS
from quarrylight.operators.normalize import smart_key

STRATEGIES = ("smart", "ip_port", "ip", "domain", "url", "host_port")
#: What a custom key may be made of.
CUSTOM_FIELDS = ("ip", "port", "domain", "host", "url", "protocol", "title", "server", "icp", "org", "asn")


def key_of(strategy: str | Sequence[str] = "smart") -> Column:
    """The merge key; a sequence of fields is a custom key, of which unknown names are ignored (none known: smart)."""
    host, port = F.lower(F.coalesce("host", "domain")), F.col("port").cast("string")
    if not isinstance(strategy, str):
        fields = [f for f in strategy if f in CUSTOM_FIELDS]
        # concat is null as soon as one part is
        parts = [p for f in fields for p in (F.lit("|"), F.lower(f) if f in ("domain", "host", "url") else F.col(f).cast("string"))][1:]
        return F.concat(*parts) if fields else smart_key()
    return {
        "smart": smart_key,
        "ip_port": lambda: F.concat("ip", F.lit(":"), port),
        "ip": lambda: F.col("ip"),
        "domain": lambda: F.lower("domain"),
        "url": lambda: F.lower("url"),
        "host_port": lambda: F.concat(host, F.lit(":"), port),
    }[strategy]()


def merge_duplicates(assets: DataFrame, strategy: str | Sequence[str] = "smart") -> DataFrame:
    """One row for each key, with ``key``, ``group_size`` and ``source_set`` beside the asset's columns.

    What is collected for a key are distinct values: elements of lists and entries of ``raw`` are combined before the
    shuffle. Only ``source``, in which repeats stay, grows with the rows of a key; where a key may have very many, leave it
    out of what is selected, and it is not made.
    """
    keyed = assets.withColumn("key", key_of(strategy)).where("key IS NOT NULL")
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in SCALARS]
    merged = keyed.groupBy("key").agg(
        *first,
        F.expr("listagg(source, '+') WITHIN GROUP (ORDER BY seq)").alias("source"),
        F.array_sort(F.collect_set("source")).alias("source_set"),
        F.min_by("created", "seq").alias("created"),
        F.min("seq").alias("seq"),
        F.count("*").alias("group_size"),
    )
    entry = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
    none = F.array().cast("array<struct<kind: string, name: string, value: string>>")
    nothing = F.lit(None).cast("string")
    of_raw = F.transform(F.map_entries("raw"), lambda e: entry("raw", e["key"], e["value"]))
    many = F.concat(*[F.coalesce(x, none) for x in (of_raw, *[_elements(c, entry, nothing) for c in LISTS])])
    entries = keyed.select("key", "seq", F.explode(many).alias("e")).select("key", "seq", "e.*")
    last = entries.groupBy("key", "kind", "name").agg(F.max_by("value", "seq").alias("value"))
    raw = F.collect_list(F.when(F.col("kind") == "raw", F.struct("name", "value")))
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == c, F.col("name")))).alias(c) for c in LISTS]
    more = last.groupBy("key").agg(F.map_from_entries(F.array_sort(raw)).alias("raw"), *lists)
    more = more.select("key", F.when(F.size("raw") > 0, F.col("raw")).alias("raw"), *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in LISTS])
    return merged.join(more, "key", "left")


def _elements(column: str, entry, value: Column) -> Column:
    return F.transform(F.array_compact(column), lambda x: entry(column, x, value))


def merge_stats(assets: DataFrame, strategy: str | Sequence[str] = "smart") -> DataFrame:
    """One row: total_in, total_out, reduced (rows without a key included), merged_groups, dropped_no_key."""
    sizes = assets.select(key_of(strategy).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    real = F.col("key").isNotNull()
    return sizes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_in"),
        F.count_if(real).alias("total_out"),
        (F.coalesce(F.sum("n"), F.lit(0)) - F.count_if(real)).alias("reduced"),
        F.count_if(real & (F.col("n") >= 2)).alias("merged_groups"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("dropped_no_key"),
    )


def preview(assets: DataFrame, strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """:func:`merge_stats` of every strategy and what share of rows it saves, from one scan: rows are stacked by strategy."""
    keys = F.array(*[F.struct(F.lit(s).alias("strategy"), key_of(s).alias("key")) for s in strategies])
    sizes = assets.select(F.inline(keys)).groupBy("strategy", "key").agg(F.count("*").alias("n"))
    real = F.col("key").isNotNull()
    out = sizes.groupBy("strategy").agg(
        F.sum("n").alias("total_in"),
        F.count_if(real).alias("total_out"),
        (F.sum("n") - F.count_if(real)).alias("reduced"),
        F.count_if(real & (F.col("n") >= 2)).alias("merged_groups"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), F.lit(0)).alias("dropped_no_key"),
    )
    return out.withColumn("percent", F.round(100.0 * F.col("reduced") / F.col("total_in"), 2))
