"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted arrays that workers map into memory.

The vocabulary is the sorted array of the words' hashes; a word's id is its place there. Bigrams are sorted arrays of
keys with counts. Both are cut into shards, so that no task holds more than its share: the vocabulary by hash
range, bigrams by context, of which those that hold many tokens are dealt over all shards. What is shuffled are sorted
blocks of differences, not rows. Tasks write the shards into the shared folder, under a final name only when complete, so
a task that runs again leaves the same.

Higher orders are left out: they would store nearly every token of the corpus once more for each order.
"""

from __future__ import annotations

import mmap
import os
import sys
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.llm.shared import blocks, checkpoint_dir, mix, sliced, staged, text_of, word_hashes

_END = np.array([0xE4D0F5EA7EC3A1B7], dtype=np.uint64)
_BLOCK = 1 << 20
_HELD = 1_500_000
_MOST_SHARDS = 1 << 16
#: A shard has about so many tokens, until there are ``_MOST_SHARDS``.
_TOKENS_A_SHARD = 1_000_000
#: What a worker keeps open: mapped arrays by number, others by bytes.
_MOST_MAPPED, _MOST_BYTES = 30_000, 512 << 20


# ---- arrays in the shared folder --------------------------------------------------------------------------------


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark reads it by; one without a scheme may be meant for HDFS."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def _local(path: str) -> str | None:
    """The path that the operating system knows, if it is one of the shared file system."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else None


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def save(path: str, array: np.ndarray) -> None:
    if at := _local(path):
        os.makedirs(os.path.dirname(at), exist_ok=True)
        part = f"{at}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, array)
        os.replace(part, at)
    else:
        store, at = _store(path)
        store.create_dir(os.path.dirname(at), recursive=True)
        sink = pa.BufferOutputStream()
        np.save(sink, array)
        part = f"{at}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(sink.getvalue())
        store.move(part, at)


def load(path: str) -> np.ndarray:
    """Mapped into memory, without keeping a file open; from a store without local paths, read into it."""
    if at := _local(path):
        with open(at, "rb") as f:
            np.lib.format.read_magic(f)
            (n,), _, kind = np.lib.format.read_array_header_1_0(f)
            if not n:
                return np.zeros(0, kind)
            free = {"trackfd": False} if sys.version_info >= (3, 13) else {}
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **free), kind, n, f.tell())
    import io

    store, at = _store(path)
    with store.open_input_file(at) as f:
        return np.load(io.BytesIO(f.read()))


# ---- counting ----------------------------------------------------------------------------------------------------


def _summed(shard: np.ndarray, key: np.ndarray, n: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards, keys and their counts (or sums of ``n``), ascending and each once."""
    if not len(key):
        return shard, key, np.zeros(0, np.int64)
    bits = int(key.max()).bit_length()
    if int(shard.max()).bit_length() + bits <= 64:
        code = shard.astype(np.uint64) << np.uint64(bits) | key if bits < 64 else key
        if n is None:
            code.sort()
        else:
            order = np.argsort(code, kind="stable")
            code, n = code[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        one = code[first]
        shard, key = ((one >> np.uint64(bits)).astype(np.int32), one & np.uint64((1 << bits) - 1)) if bits < 64 else (np.zeros(len(one), np.int32), one)
    else:
        order = np.lexsort((key, shard))
        shard, key, n = shard[order], key[order], None if n is None else n[order]
        first = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]))))
        code, shard, key = key, shard[first], key[first]
    return shard, key, np.diff(np.append(first, len(code))) if n is None else np.add.reduceat(n, first)


class Tally:
    """Sums by (shard, key), merged whenever many are held."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, shard: np.ndarray, key: np.ndarray, n: np.ndarray | None = None) -> None:
        if len(key):
            self.parts.append(_summed(shard, key, n))
            self.held += len(self.parts[-1][0])
            if self.full and len(self.parts) > 1:
                self.parts = [self.all()]
                self.held = len(self.parts[0][0])

    @property
    def full(self) -> bool:
        return self.held > _HELD

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int32), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return _summed(*(np.concatenate([p[i] for p in self.parts]) for i in range(3)))


def packed(key: np.ndarray) -> bytes:
    """Ascending keys as their first and the differences, in 4 bytes each where those suffice."""
    steps = np.diff(key)
    small = not len(steps) or int(steps.max()) < 1 << 32
    return b"\x04\x08"[0 if small else 1 :][:1] + key[:1].tobytes() + steps.astype(np.uint32 if small else np.uint64).tobytes()


def unpacked(data) -> np.ndarray:
    kind = np.uint32 if bytes(data[:1]) == b"\x04" else np.uint64
    return np.cumsum(np.concatenate((np.frombuffer(data, np.uint64, 1, 1), np.frombuffer(data, kind, -1, 9).astype(np.uint64))), dtype=np.uint64)


def _words_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, keys ascending, counts) of the whole shards that a task has."""
    parts: dict[int, Tally] = {}
    for b in batches:
        for shard, keys, counts in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
            key = unpacked(keys.as_buffer())
            parts.setdefault(shard, Tally()).add(np.full(len(key), shard, np.int32), key, np.frombuffer(counts.as_buffer(), np.uint32).astype(np.int64))
    for shard in list(parts):
        yield shard, *parts.pop(shard).all()[1:]


def tokens(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, hashes, tokens of each text) of blocks of texts: words with A-Z lowered, then the end."""
    for first, some in blocks((t.encode("utf-8", "replace").lower() for t in texts), _BLOCK):
        words, counts = word_hashes(some)
        ends = np.cumsum(counts)
        yield first, np.insert(words, ends, _END[0]), counts + 1


_ROWS = "shard int, keys binary, counts binary"


def _batches(texts: Iterator[pa.RecordBatch], each: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Blocks of the sums of the (shards, keys) that ``each`` makes of texts: a row for each shard whenever many sums are held."""
    tally = Tally()

    def out() -> Iterator[pa.RecordBatch]:
        shard, key, n = tally.all()
        cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
        for at in range(0, len(cuts) - 1, 64):
            some = list(zip(cuts[at : at + 64], cuts[at + 1 : at + 65], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([int(shard[i]) for i, _ in some], pa.int32()), pa.array([packed(key[i:j]) for i, j in some], pa.binary()), pa.array([np.minimum(n[i:j], 2**32 - 1).astype(np.uint32).tobytes() for i, j in some], pa.binary())], names=["shard", "keys", "counts"])

    for batch in sliced(texts):
        for _, hashes, counts in tokens(batch.column(0).to_pylist()):
            tally.add(*each(hashes, counts))
            if tally.full:
                yield from out()
                tally = Tally()
    if tally.parts:
        yield from out()


# ---- the model ---------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """Where the arrays are and the few numbers beside them. Word ids are places in the sorted hashes; ``bos``, an id of its own, is a context only.

    A bigram's shard is its context's id modulo the number of shards, and its key has the rest of that id above the
    word's. Contexts in ``hot`` are dealt by word instead, and their keys have their places in ``hot`` behind all others.
    """

    folder: str
    bits: int = 4
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tokens: int = 0
    shards: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    unseen: float = 1.0
    bos: tuple[float, float] = (0.0, 1.0)
    _open: OrderedDict = field(default_factory=OrderedDict, repr=False)
    _bytes: int = field(default=0, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_open": OrderedDict(), "_bytes": 0}

    @property
    def words(self) -> int:
        return int(self.starts[-1]) if len(self.starts) else 0

    def array(self, name: str, shard: int) -> np.ndarray:
        at = (name, int(shard))
        if at in self._open:
            self._open.move_to_end(at)
            return self._open[at]
        path = f"{self.folder}/{name}-{at[1]:05d}.npy"
        own = 0 if _local(path) else 1
        self._open[at] = load(path)
        self._bytes += own * self._open[at].nbytes
        while len(self._open) > 1 and (len(self._open) > _MOST_MAPPED or self._bytes > _MOST_BYTES):
            self._bytes -= own * self._open.popitem(last=False)[1].nbytes
        return self._open[at]

    def vocabulary_shard(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shards, and the rest of the hashes as keys."""
        below = np.uint64(64 - self.bits)
        return (hashes >> below).astype(np.int32), hashes & np.uint64((1 << int(below)) - 1)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Places in the vocabulary, -1 for unknown words."""
        distinct, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), -1, dtype=np.int64)
        for s, lo, hi in _runs((distinct >> np.uint64(64 - self.bits)).astype(np.int64)):
            if self.starts[s + 1] > self.starts[s]:
                held = self.array("hash", s)
                at = np.minimum(np.searchsorted(held, distinct[lo:hi]), len(held) - 1)
                out[lo:hi] = np.where(held[at] == distinct[lo:hi], at + self.starts[s], -1)
        return out[back]

    def dense(self, name: str, ids: np.ndarray, missing: float) -> np.ndarray:
        """Values at ``ids``; ``missing`` for those below 0 or beyond the vocabulary."""
        distinct, back = np.unique(ids, return_inverse=True)
        out = np.full(len(distinct), missing, dtype=np.float64)
        first = np.searchsorted(distinct, 0)
        known = distinct[first : np.searchsorted(distinct, self.words)]
        for s, lo, hi in _runs(np.searchsorted(self.starts, known, side="right") - 1):
            out[first + lo : first + hi] = self.array(name, s)[known[lo:hi] - self.starts[s]]
        return out[back]

    def coded(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shards and keys of bigrams of ids."""
        context, word = context.astype(np.uint64), word.astype(np.uint64)
        n, wide = np.uint64(self.shards), np.uint64(self.words.bit_length())
        rest, shard = context // n, context % n
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context.view(np.int64)), len(self.hot) - 1)
            hot = self.hot[at] == context.view(np.int64)
            rest = np.where(hot, np.uint64(self.words // self.shards + 1) + at.astype(np.uint64), rest)
            with np.errstate(over="ignore"):
                shard = np.where(hot, mix(word + np.uint64(1)) % n, shard)
        return shard.astype(np.int32), rest << wide | word

    def decoded(self, shard: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts and words of a shard's keys; equal contexts stand together where keys are ascending."""
        wide = np.uint64(self.words.bit_length())
        rest, word = (key >> wide).astype(np.int64), (key & np.uint64((1 << int(wide)) - 1)).astype(np.int64)
        first = self.words // self.shards + 1
        context = rest * self.shards + shard
        hot = rest >= first
        context[hot] = self.hot[rest[hot] - first]
        return context, word

    def bigrams(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Training counts of bigrams."""
        shard, key = self.coded(context, word)
        out = np.zeros(len(key), dtype=np.float64)
        order = np.argsort(shard, kind="stable")
        for s, lo, hi in _runs(shard[order]):
            at = order[lo:hi]
            at = at[np.argsort(key[at])]  # near keys are on near pages
            held = self.array("bigram", s)
            if len(held):
                place = np.minimum(np.searchsorted(held, key[at]), len(held) - 1)
                out[at] = np.where(held[place] == key[at], self.array("times", s)[place], 0)
        return out

    def pairs(self, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands before each token, and the token: ids."""
        ids = self.ids(hashes)
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[np.concatenate(([0], np.cumsum(counts)[:-1]))] = self.words
        return before, ids


def _runs(ascending: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, start, end) of runs of equal values."""
    if len(ascending):
        cuts = [0, *(np.flatnonzero(np.diff(ascending)) + 1).tolist(), len(ascending)]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield int(ascending[lo]), lo, hi


def _discounts(n: list[float]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts 1 to 4; where those are too few, plain ones. None is 0, so that unseen bigrams keep some probability."""
    if min(n) <= 0:
        d = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] > 0 else 0.5
        return (min(max(d, 0.05), 0.9),) * 3
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(float(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05)) for k in (1, 2, 3))


def held_out(key: Column) -> Column:
    """Documents that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 1, F.lit(False))


def _shards_for(entries: int, each: int, least: int = 16) -> int:
    return min(_MOST_SHARDS, max(least, -(-entries // each)))


def train(texts: DataFrame, tokens_a_shard: int = _TOKENS_A_SHARD) -> Model:
    """Fit on the one column of ``texts``. What comes to the driver is bounded: a few numbers for each of at most 65,536 shards, and at most two contexts a shard."""
    spark = texts.sparkSession
    texts = texts.select(text_of(texts.columns[0]).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (_shards_for(size, 32 * tokens_a_shard) - 1).bit_length()
    model = Model(f"{qualified(spark, checkpoint_dir(spark))}/kneser-ney-{uuid.uuid4().hex}", bits=bits)
    at = model

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, keys, n in _words_of_shards(batches):
            save(f"{model.folder}/hash-{shard:05d}.npy", np.uint64(shard) << np.uint64(64 - bits) | keys)
            save(f"{model.folder}/count-{shard:05d}.npy", n)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "words": pa.array([len(keys)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    words = texts.mapInArrow(lambda b: _batches(b, lambda h, _: model.vocabulary_shard(h)), _ROWS)
    sizes = words.repartition(1 << bits, "shard").mapInArrow(write_words, "shard int, words long, tokens long").collect()
    by = {r["shard"]: r["words"] for r in sizes}
    starts = np.concatenate(([0], np.cumsum([by.get(s, 0) for s in range(1 << bits)]))).astype(np.int64)
    n_tokens = sum(r["tokens"] for r in sizes)
    if not n_tokens:
        return model
    shards = _shards_for(n_tokens, tokens_a_shard)
    most = max(1, n_tokens // shards // 2)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard in b.column(0).to_pylist():
                if starts[shard + 1] > starts[shard]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(model.array("count", shard) > most) + starts[shard])], names=["id"])

    # an end is no context, the start is one as often
    hot = {r["id"] for r in spark.range(1 << bits).mapInArrow(frequent, "id long").collect()} | {int(starts[-1])}
    at = model = replace(model, starts=starts, tokens=n_tokens, shards=shards, hot=np.array(sorted(hot), dtype=np.int64))

    def write_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, k, n in _words_of_shards(batches):
            save(f"{at.folder}/bigram-{shard:05d}.npy", k)
            save(f"{at.folder}/times-{shard:05d}.npy", n.astype(np.uint32) if n.max() < 1 << 32 else n)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "types": pa.array([len(k)], pa.int64()), **{f"n{i}": pa.array([int((n == i).sum())], pa.int64()) for i in (1, 2, 3, 4)}})

    bigrams = texts.mapInArrow(lambda b: _batches(b, lambda h, c: at.coded(*at.pairs(h, c))), _ROWS)
    made = bigrams.repartition(shards, "shard").mapInArrow(write_bigrams, "shard int, types long, n1 long, n2 long, n3 long, n4 long").collect()
    for s in set(range(shards)) - {r["shard"] for r in made}:
        save(f"{at.folder}/bigram-{s:05d}.npy", np.zeros(0, np.uint64))
        save(f"{at.folder}/times-{s:05d}.npy", np.zeros(0, np.uint32))
    types = sum(r["types"] for r in made)
    discounts = _discounts([sum(r[f"n{i}"] for r in made) for i in (1, 2, 3, 4)])

    def read_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a shard says of its words: as a context (tokens, successors met once, twice, more often) and as a word (predecessors)."""
        for b in batches:
            for shard in b.column(0).to_pylist():
                k, n = at.array("bigram", shard), at.array("times", shard).astype(np.int64)
                if not len(k):
                    continue
                contexts, following = at.decoded(shard, k)
                first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1])))
                context = contexts[first]
                sums = [np.add.reduceat(x, first) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))]
                zero = np.zeros(len(context), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(zero), *map(pa.array, sums)], names=names)
                word, before = np.unique(following, return_counts=True)
                zero = np.zeros(len(word), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(before), *[pa.array(zero)] * 4], names=names)

    names = ["id", "before", "tokens", "one", "two", "more"]
    facts = spark.range(shards).repartition(shards, "id").mapInArrow(read_bigrams, ", ".join(f"{c} long" for c in names))
    facts = staged(facts.groupBy("id").agg(*[F.sum(c).alias(c) for c in names[1:]]), "word-facts")
    is_word = F.col("id") < at.words
    low = facts.where(is_word).agg(*[F.count_if(F.col("before") == i).alias(f"n{i}") for i in (1, 2, 3, 4)], F.count_if(F.col("before") >= 3).alias("more")).first()
    below = _discounts([low[f"n{i}"] for i in (1, 2, 3, 4)])
    unseen = (below[0] * low["n1"] + below[1] * low["n2"] + below[2] * low["more"]) / types / (at.words + 1)

    def leave(one, two, more, n):
        return (discounts[0] * one + discounts[1] * two + discounts[2] * more) / np.maximum(n, 1)

    def write_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[np.ndarray]] = {}
        for b in batches:
            x = np.array([b.column(c).to_numpy() for c in names])
            shard = np.searchsorted(at.starts, x[0], side="right") - 1
            for s in np.unique(shard):
                parts.setdefault(int(s), []).append(x[:, shard == s])
        for s, some in parts.items():
            ids, before, n, one, two, more = np.concatenate(some, axis=1)
            size = int(at.starts[s + 1] - at.starts[s])
            place = ids - at.starts[s]
            alone, backoff, total = np.full(size, unseen, np.float32), np.ones(size, np.float32), np.zeros(size, np.int64)
            off = np.array([0.0, *below])[np.minimum(before, 3)]
            alone[place] = (before - off) / types + unseen
            backoff[place] = np.where(n > 0, leave(one, two, more, n), 1.0)
            total[place] = n
            for name, array in (("alone", alone), ("backoff", backoff), ("total", total)):
                save(f"{at.folder}/{name}-{s:05d}.npy", array)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([s], pa.int32())})

    words = facts.where(is_word).mapInArrow(_exact_shard(at, names), ", ".join(f"{c} long" for c in names) + ", shard int")
    words.repartition(1 << bits, "shard").mapInArrow(write_facts, "shard int").collect()
    start = facts.where(~is_word).first()
    n = start["tokens"] if start else 0
    bos = (float(n), float(leave(start["one"], start["two"], start["more"], n)) if n else 1.0)
    return replace(at, discounts=discounts, unseen=float(unseen), bos=bos)


def _exact_shard(model: Model, names: list[str]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = np.searchsorted(model.starts, b.column("id").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(shard.astype(np.int32))], names=[*names, "shard"])

    return mark


def log10s(model: Model, hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token whether it is known, its add-half unigram log10 probability and the model's."""
    if not model.words:
        return np.zeros(len(hashes), bool), np.zeros(len(hashes)), np.zeros(len(hashes))
    before, ids = model.pairs(hashes, counts)
    times = model.dense("count", ids, 0.0)
    base = np.log10((times + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    total = np.where(before == model.words, model.bos[0], model.dense("total", np.where(before == model.words, -1, before), 0.0))
    backoff = np.where(before == model.words, model.bos[1], model.dense("backoff", np.where(before == model.words, -1, before), 1.0))
    both = (ids >= 0) & (before >= 0)
    n = np.zeros(len(ids))
    n[both] = model.bigrams(before[both], ids[both])
    off = np.array([0.0, *model.discounts])[np.minimum(n, 3).astype(np.int64)]
    p = (n - off) / np.maximum(total, 1) + backoff * model.dense("alone", ids, model.unseen)
    return times > 0, base, np.log10(p)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the text), perplexity.

    A null text is empty; an empty text has its end token. Repeated rows get equal scores; an empty table gives no
    rows; a model of no text gives every token probability 1.
    """
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 512):
            out = []
            for _, hashes, counts in tokens(b.column(1).to_pylist()):
                known, base, own = log10s(model, hashes, counts)
                first = np.concatenate(([0], np.cumsum(counts)[:-1]))
                s = np.add.reduceat(own, first)
                out.append((counts, np.add.reduceat(known.astype(np.int64), first), np.full(len(counts), model.tokens), np.add.reduceat(base, first), s, 10 ** np.minimum(-s / counts, 300)))
            cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 6
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)]], names=[key, *names])

    return docs.select(key, text_of(text).alias("_text")).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
