"""Merges and distinct counts over inventories that grow: partial results that combine, kept as tables.

A store is a log of runs. A batch adds one small run; once a level has :data:`FAN` runs of neighbouring batches they become one of the next level, so
a row is rewritten as often as there are levels, and adding costs what the batch holds. Runs are named by their batch: adding a
batch again replaces its run, so a repeated micro-batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions.classify import root_domain
from quarrylight.model import LISTS, SCALARS
from quarrylight.operators.dedup import key_of

FAN = 4


class _Log:
    """Runs of one table below ``root``: ``level=L/first=A/last=B``. A run counts unless a run of a higher level holds its batches."""

    def __init__(self, spark: SparkSession, root: str, combine: Callable[[DataFrame], DataFrame]):
        self.spark, self.root, self.combine = spark, root.rstrip("/"), combine

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self) -> list[tuple[int, int, int, str]]:
        """(level, first, last, path) of the finished runs that count."""
        p, fs = self._fs(self.root)
        if not fs.exists(p):
            return []
        found = []
        for status in fs.listStatus(p):
            at = status.getPath()
            if not fs.exists(self._fs(f"{at}/_SUCCESS")[0]):
                continue
            level, first, last = map(int, at.getName().split("-"))
            found.append((level, first, last, str(at)))
        return [r for r in found if not any(o[0] > r[0] and o[1] <= r[1] and r[2] <= o[2] for o in found)]

    def add(self, batch: int, rows: DataFrame) -> None:
        if any(level and first <= batch <= last for level, first, last, _ in self.runs()):
            return  # it is part of a larger run already
        self.combine(rows).write.mode("overwrite").parquet(f"{self.root}/0-{batch}-{batch}")
        level = 0
        while own := self._neighbours(level):
            self.combine(self._read([r[3] for r in own])).write.mode("overwrite").parquet(f"{self.root}/{level + 1}-{own[0][1]}-{own[-1][2]}")
            for r in own:  # readers that still have them fail and read again; what replaces them is there
                p, fs = self._fs(r[3])
                fs.delete(p, True)
            level += 1

    def _neighbours(self, level: int) -> list[tuple[int, int, int, str]]:
        """:data:`FAN` runs of a level whose batches follow one another without a gap, if there are; a batch that is still to come is never taken for one that is there."""
        own = sorted(r for r in self.runs() if r[0] == level)
        for i in range(len(own) - FAN + 1):
            some = own[i : i + FAN]
            if all(a[2] + 1 == b[1] for a, b in zip(some, some[1:], strict=False)):
                return some
        return []

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*paths)

    def all(self) -> DataFrame | None:
        runs = self.runs()
        return self._read([r[3] for r in runs]) if runs else None


def _pair(column: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.struct("seq", F.col(column).alias("value"))).alias(column)


class MergedAssets:
    """Assets merged by one strategy, batch by batch; :meth:`result` equals :func:`dedup.merge_duplicates` over all of them.

    Kept are, for each key, the first value of each scalar with its ``seq``; and, for each key and element of a list, name of
    ``raw`` or arrival of a source, the last value. ``seq`` must tell rows apart over all batches, which may come in any order.
    """

    _HEADS = (*SCALARS, "created")

    def __init__(self, spark: SparkSession, root: str, strategy: str | Sequence[str] = "smart"):
        self.strategy = strategy
        self.heads = _Log(spark, f"{root}/heads", self._heads)
        self.elements = _Log(spark, f"{root}/elements", self._elements)

    def _heads(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(*[F.min(c).alias(c) for c in self._HEADS], F.min("seq").alias("seq"), F.sum("group_size").alias("group_size"))

    def _elements(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("key", "kind", "name").agg(F.max("last").alias("last"))

    def add(self, batch: int, assets: DataFrame) -> None:
        """Merge a batch; the same number again changes nothing."""
        keyed = assets.withColumn("key", key_of(self.strategy)).where("key IS NOT NULL")
        self.heads.add(batch, keyed.select("key", "seq", *[_pair(c) for c in self._HEADS], F.lit(1).cast("long").alias("group_size")))
        entry = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
        none, nothing = F.array().cast("array<struct<kind: string, name: string, value: string>>"), F.lit(None).cast("string")
        raw = F.transform(F.map_entries("raw"), lambda e: entry("raw", e["key"], e["value"]))
        of_list = lambda c: F.transform(F.array_compact(c), lambda x: entry(c, x, nothing))
        lists = [of_list(c) for c in LISTS]
        source = F.when(F.col("source").isNotNull(), F.array(entry("source", F.col("seq").cast("string"), F.col("source"))))
        many = F.concat(*[F.coalesce(x, none) for x in (raw, source, *lists)])
        rows = keyed.select("key", "seq", F.explode(many).alias("e"))
        self.elements.add(batch, rows.select("key", "e.kind", "e.name", F.struct("seq", "e.value").alias("last")))

    def result(self) -> DataFrame:
        heads, elements = self._heads(self.heads.all()), self._elements(self.elements.all())
        of = lambda kind, value: F.collect_list(F.when(F.col("kind") == kind, value))
        more = elements.groupBy("key").agg(
            F.map_from_entries(F.array_sort(of("raw", F.struct("name", "last.value")))).alias("raw"),
            F.transform(F.array_sort(of("source", F.struct("last.seq", "last.value"))), lambda s: s["value"]).alias("sources"),
            *[F.array_sort(of(c, F.col("name"))).alias(c) for c in LISTS],
        )
        filled = lambda c: F.when(F.size(c) > 0, F.col(c))
        more = more.select("key", filled("raw").alias("raw"), F.when(F.size("sources") > 0, F.array_join("sources", "+")).alias("source"), F.array_sort(F.array_distinct("sources")).alias("source_set"), *[filled(c).alias(c) for c in LISTS])
        none = F.array().cast("array<string>")
        out = heads.select("key", *[F.col(c)["value"].alias(c) for c in self._HEADS], "seq", "group_size").join(more, "key", "left")
        return out.withColumn("source_set", F.coalesce("source_set", none))


class RootCounts:
    """Distinct subdomains and addresses of each root domain over any number of sessions, as sketches that combine.

    A session's sketches are one small run; ``error`` is the relative standard error (1.04 / sqrt(2^bits)). Exact counts are
    :func:`report.root_domains`.
    """

    def __init__(self, spark: SparkSession, root: str, bits: int = 12):
        self.bits = bits
        self.log = _Log(spark, root, self._combined)

    @property
    def error(self) -> float:
        return 1.04 / 2 ** (self.bits / 2)

    def _combined(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy("root_domain").agg(F.hll_union_agg("subdomains").alias("subdomains"), F.hll_union_agg("ips").alias("ips"), F.sum("assets").alias("assets"))

    def add(self, session: int, assets: DataFrame) -> None:
        own = assets.select(root_domain(F.col("domain")).alias("root_domain"), "domain", "ip").where("root_domain IS NOT NULL")
        self.log.add(session, own.groupBy("root_domain").agg(F.hll_sketch_agg("domain", self.bits).alias("subdomains"), F.hll_sketch_agg("ip", self.bits).alias("ips"), F.count("*").alias("assets")))

    def result(self) -> DataFrame:
        """(root_domain, subdomains, ips, assets); the assets are exact."""
        both = self._combined(self.log.all())
        return both.select("root_domain", F.hll_sketch_estimate("subdomains").alias("subdomains"), F.hll_sketch_estimate("ips").alias("ips"), "assets")
