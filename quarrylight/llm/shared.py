"""Helpers that several corpus operators share: lineage cuts, numbering, vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where the session names no folder of its own and runs on one machine, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session (``spark.checkpoint.dir``). Only a session in one process may leave it unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = LOCAL_CHECKPOINTS
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def staged(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: a lineage cut that outlives executors.

    ``rows``: about how many of them to expect, where that is known; it keeps small tables from becoming very many files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // 5_000)))
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The text, a null being empty."""
    return F.coalesce(F.col(column), F.lit(""))


def kept_columns(df: DataFrame, *replaced: str) -> list[str]:
    """The columns of ``df`` but those that ``replaced`` names; case does not count, as in Spark."""
    gone = {r.lower() for r in replaced}
    return [c for c in df.columns if c.lower() not in gone]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each changed until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, rows_per_bucket: int = 50_000) -> DataFrame:
    """Gapless numbers from 0 within each ``group``, without bringing a group together in one task.

    Rows of a group are dealt into hash buckets of ``order``; each bucket is numbered alone, and starts at the sum of
    the buckets before it. A bucket has about ``rows_per_bucket`` rows, and not more than a thousandth of all. There must be few
    groups (lengths, shards): a row for each comes to the driver. ``df`` is read three times, so it should be staged.
    Rows that are equal in ``order`` share a bucket and are numbered in any order, so ``order`` should end with a column
    that tells equal rows apart (:func:`salted`). Null is a value like any other.
    """
    spark = df.sparkSession
    sizes = df.groupBy(*group).agg(F.count("*").alias("_rows"))
    schema = sizes.schema
    known = sizes.collect()  # few: see above
    each = min(rows_per_bucket, max(200, sum(r["_rows"] for r in known) // 1000))  # a bucket is never a large part of all rows
    held = [(*r[:-1], max(1, -(-r["_rows"] // each))) for r in known]
    few = F.broadcast(spark.createDataFrame(held, schema)).withColumnRenamed("_rows", "_buckets")
    bucketed = df.join(few, _same(df, few, group)).select(*[df[c] for c in df.columns], F.pmod(F.xxhash64(*[df[c] for c in order]), few["_buckets"]).alias("_bucket"))
    keys = [*group, "_bucket"]
    starts = bucketed.groupBy(*keys).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    ranked = bucketed.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.join(starts, _same(ranked, starts, keys)).select(*[ranked[c] for c in df.columns], (F.col("_start") + F.col("_at") - 1).cast("long").alias(out))


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equal in ``keys``, null being a value."""
    on = a[keys[0]].eqNullSafe(b[keys[0]])
    for k in keys[1:]:
        on = on & a[k].eqNullSafe(b[k])
    return on


def salted(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number that tells equal rows apart. It is fixed once the result is staged."""
    return df.withColumn(name, F.monotonically_increasing_id())


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], n: str, most_broadcast: int = 10_000, parts: int = 1000) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each key and in ``n`` how many of ``rows`` have it.

    A table of at most ``most_broadcast`` rows is broadcast. Beyond, only the keys that hold more than one part in ``parts`` of
    all rows are, of which there are less than ``parts``, so that their rows stay where they are; the others are joined by
    shuffle, where no key is large. Both sides are read twice then. Rows whose key is not in ``table`` are left out.
    """
    total, groups = table.agg(F.sum(n), F.count("*")).first()
    if groups <= most_broadcast:
        return rows.join(F.broadcast(table), keys)
    hot = F.broadcast(table.where(F.col(n) * parts > total))
    cold = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col(n) * parts <= total), keys)
    return rows.join(hot, keys).unionByName(cold)


def row_keys(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", bits: int = 62) -> DataFrame:
    """``docs`` with ``out``, a long that two rows share only if both their key and their text are equal.

    It is the key itself, unless the key is null or several texts have it; such rows get a negative hash of both, of
    ``bits`` bits. Different rows that share one draw again until none do; the others keep theirs. A null text is empty. What is
    shuffled are numbers; texts only where keys are ambiguous.
    """
    number = F.col(key).cast("long")
    whole = text_of(text)
    facts = docs.select(number.alias("k"), F.xxhash64(whole).alias("h"), F.hash(whole, F.octet_length(whole)).alias("g"))
    several = facts.where("k is not null").groupBy("k").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.min("g").alias("lo2"), F.max("g").alias("hi2"))
    several = several.where("lo <> hi or lo2 <> hi2").select("k")
    mark, at, met = fresh(docs, "_several", "_at", "_met")
    marked = docs.withColumn(mark, F.lit(False))
    n = several.count()
    if not n and docs.where(number.isNull() | (number < 0)).isEmpty():
        return docs.withColumn(out, number)
    if n:
        several = staged(several, "ambiguous-keys")
        if n <= 100_000:
            several = F.broadcast(several)
        found = several.withColumn(mark, F.lit(True))
        marked = docs.join(found, docs[key].cast("long") == found["k"], "left").select(*[docs[c] for c in docs.columns], F.coalesce(found[mark], F.lit(False)).alias(mark))
    odd = F.col(mark) | number.isNull()
    drawn = lambda seed: -F.shiftrightunsigned(F.xxhash64(number, whole, F.lit(seed)), 64 - bits) - 1
    keyed = marked.withColumn(out, F.when(odd, drawn(0)).otherwise(number))
    for seed in range(1, 64):
        rows = keyed.where(F.col(out) < 0).select(F.col(out).alias(at), number.alias("k"), F.hash(whole, F.octet_length(whole)).alias("g"), F.xxhash64(whole).alias("h"))
        ends = [F.min(x) != F.max(x) for x in ("g", "h", F.coalesce(F.col("k"), F.lit(0)), F.col("k").isNull())]
        twice = rows.groupBy(at).agg((ends[0] | ends[1] | ends[2] | ends[3]).alias(met)).where(met)
        if twice.isEmpty():
            return keyed.select(*docs.columns, out)
        # the rows that share a key, and no others, draw again, below all keys of the first draw
        twice = staged(twice, "shared-keys")
        if twice.count() <= 100_000:
            twice = F.broadcast(twice)
        now = F.when(odd & F.col(met), drawn(seed) - (1 << bits)).otherwise(F.col(out))
        keyed = keyed.join(twice, keyed[out] == twice[at], "left").select(*docs.columns, mark, now.alias(out))
    raise ValueError(f"no seed tells the rows of {key} apart")


def bit_map(ids: DataFrame, id_: str, most_bits: int = 1 << 27, per_id: int = 8) -> tuple[np.ndarray | None, Column]:
    """(bytes, place): a bit map of the hashes of ``ids``, and the bit of a row's ``id_`` in it. It has ``per_id`` bits an id and
    16 MB at most; where that is too small for them, it is None."""
    bits = max(1 << 15, 1 << (per_id * max(1, ids.count()) - 1).bit_length())
    place = F.pmod(F.xxhash64(id_), F.lit(min(bits, most_bits)))
    if bits > most_bits:
        return None, place
    marks = ids.select(F.shiftright(place, 15).alias("_part"), F.pmod(place, F.lit(1 << 15)).alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    seen = np.zeros(bits // 8, dtype=np.uint8)
    for r in marks.collect():  # bounded: 4 KB for each 32768 bits
        seen[r["_part"] << 12 : (r["_part"] + 1) << 12] = np.frombuffer(r["_bits"], dtype=np.uint8)
    return seen, place


def in_bit_map(seen: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (seen[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python get fewer rows at a time than Spark's default, if the session has that: texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """``batches`` in parts of at most ``rows``, without copies, so that few texts are Python strings at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


# ---- words of many texts at once -------------------------------------------------------------------------------

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence's hash and that of its next word."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + (b ^ np.uint64(0xA0761D6478BD642F)))


_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        for name, base in (("up", _P), ("down", _P_INV)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of UTF-8 ``texts`` (split at bytes 0x20 and 0x09-0x0D) and, per text, how many.

    A polynomial over the bytes of all texts at once, made independent of the place by the inverse power. Keep a
    call to a MB of text or so: it takes about 60 bytes of memory for each byte.
    """
    counts = np.zeros(len(texts), dtype=np.int64)
    if not texts:
        return np.zeros(0, dtype=np.uint64), counts
    joined = np.frombuffer(b" " + b" ".join(texts) + b" ", dtype=np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, dtype=np.uint64), counts
    up, down = _power(len(joined))
    with np.errstate(over="ignore"):
        sums = np.cumsum(up * (joined.astype(np.uint64) + np.uint64(1)), dtype=np.uint64)
        value = (sums[end - 1] - sums[start - 1]) * down[start]
        hashes = mix(value + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    begins = np.concatenate(([1], 1 + np.cumsum(lengths + 1)))
    counts = np.diff(np.searchsorted(start, begins))
    return hashes, counts


def blocks(texts, most: int = 1 << 19):
    """(index of first, UTF-8 texts) of runs of about ``most`` bytes."""
    run, size, first = [], 0, 0
    for i, t in enumerate(texts):
        run.append(t)
        size += len(t)
        if size >= most:
            yield first, run
            run, size, first = [], 0, i + 1
    if run:
        yield first, run
