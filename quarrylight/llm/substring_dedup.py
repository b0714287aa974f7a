"""Exact removal of repeated passages by super-k-mers of words.

A window is ``k`` consecutive words of a document; its minimiser is the least hash of the ``M``-grams in it. Consecutive
windows that share their minimiser are a super-k-mer and travel as one packed string to the minimiser's bucket; equal
windows always meet there. The bucket sorts the windows of its strings, compares equal hashes word by word and finds the
least document of each window.

Hot keys: minimisers with a large share of all windows are counted first. Their windows travel alone, by their own hash, so
contexts of a common phrase part ways; a window that is hot itself (a passage in a large share of the documents) travels as
one string a task with its least document only, and the documents that hold it get the answer from a table of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.shared import blocks, combine, mix, sliced, staged, text_of, word_hashes

M = 3
#: Windows of one super-k-mer, at most; longer runs of a minimiser (one word again and again) are cut.
LONGEST = 64
#: Windows of one bucket, about.
BUCKET = 200_000
#: Bytes of packed strings and of what goes with them that a task holds back to add up equal ones.
HELD = 64 << 20


def _rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive word hashes (over all texts; the caller keeps those within one)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for i in range(1, k):
            out = combine(out, hashes[i : i + n])
    return out


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values."""
    if len(values) < n:
        return values[:0]
    have, out = 1, values
    while have < n:
        step = min(have, n - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class _Cut:
    """Windows of some texts: of each its text, first word, minimiser and hash. Keep a call to a MB of text or so."""

    def __init__(self, texts: list[bytes], k: int):
        self.words, counts = word_hashes(texts)
        self.counts, ends = counts, np.cumsum(counts)
        n = np.maximum(counts - k + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), n)
        self.first = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.at, self.k = np.repeat(ends - counts, n) + self.first, k

    def keys(self) -> np.ndarray:
        """Minimisers of all windows."""
        m = min(M, self.k)
        least = _least(_rolling(self.words, m), self.k - m + 1)
        return least[self.at] if len(self.at) else np.zeros(0, dtype=np.uint64)

    def hashes(self, which: np.ndarray) -> np.ndarray:
        """Hashes of some windows."""
        if not len(which):
            return np.zeros(0, dtype=np.uint64)
        at = self.at[which]
        out = self.words[at].copy()
        with np.errstate(over="ignore"):
            for i in range(1, self.k):
                out = combine(out, self.words[at + i])
        return mix(out)


def _member(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table) or not len(x):
        return np.zeros(len(x), dtype=bool)
    return table[np.minimum(np.searchsorted(table, x), len(table) - 1)] == x


def _hot(docs: DataFrame, k: int, share: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(minimisers, windows, total): those with a large share of all windows, ascending hashes, at most ``1 / share`` each; and how many windows there are.

    A task names what has at least ``share`` of its own windows, 16 at least. What has twice the share of all windows has the
    share in some task, and what tasks name adds up to half of it or more. So none is missed, and little is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {0: [], 1: []}
        total = 0

        def added(kind: int) -> tuple[np.ndarray, np.ndarray]:
            values, n = (np.concatenate(x) for x in zip(*sums[kind], strict=True))
            values, at = np.unique(values, return_inverse=True)
            return values, np.bincount(at, weights=n).astype(np.int64)

        for batch in sliced(batches):
            for _, texts in blocks(t.encode() for t in batch.column(0).to_pylist()):
                cut = _Cut(texts, k)
                total += len(cut.at)
                keys, at, n = np.unique(cut.keys(), return_inverse=True, return_counts=True)
                sums[0].append((keys, n))
                # a hot window has a hot minimiser, in the block where it is frequent as well
                some = np.flatnonzero(n[at] >= 2) if len(at) else np.zeros(0, dtype=np.int64)
                windows, n = np.unique(cut.hashes(some), return_counts=True)
                sums[1].append((windows[n > 1], n[n > 1]))
                for kind in (0, 1):
                    if sum(len(x[0]) for x in sums[kind]) > 2_000_000:
                        values, n = added(kind)
                        least = max(2, share * total / 4)  # what is rarer so far may be named too low, by a quarter of the share
                        sums[kind] = [(values[n >= least], n[n >= least])]
        for kind in (0, 1):
            values, n = added(kind) if sums[kind] else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            keep = n >= max(16, share * total / 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(keep.sum()), kind, np.int32)), pa.array(values[keep].view(np.int64)), pa.array(n[keep])], names=["kind", "value", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([total], pa.int64())], names=["kind", "value", "n"])

    sums = staged(docs.select("text").mapInArrow(count, "kind int, value long, n long").groupBy("kind", "value").agg(F.sum("n").alias("n")), "hot-windows", 100_000)
    total = sums.where("kind = 2").agg(F.sum("n")).first()[0] or 0
    found = sums.where((F.col("kind") < 2) & (F.col("n") >= max(16, int(share * total)))).toPandas()  # 2 / share rows at most
    return (*(np.sort(found.loc[found["kind"] == kind, "value"].to_numpy(np.int64).view(np.uint64)) for kind in (0, 1)), int(total))


class _Parcel:
    """Packed strings on their way to one bucket, compressed together, with which documents hold each and where.

    ``hot`` strings are hot windows and name just the least and the largest of their documents.
    """

    ARRAYS = (("hot", "u1"), ("holders", "<u4"), ("lengths", "<u4"), ("docs", "<i8"), ("tags", "<i8"), ("firsts", "<i4"))

    def __init__(self, strings: list[bytes], **arrays: np.ndarray):
        self.strings = strings
        for name, kind in self.ARRAYS:
            setattr(self, name, arrays[name].astype(kind))

    def packed(self, squeeze) -> bytes:
        parts = [getattr(self, name).tobytes() for name, _ in self.ARRAYS]
        return squeeze(b"".join([np.array([len(self.strings), len(self.docs)], dtype="<u4").tobytes(), *parts, *self.strings]))

    @classmethod
    def of(cls, raw: bytes) -> _Parcel:
        n, held = np.frombuffer(raw, "<u4", 2).tolist()
        at, arrays = 8, {}
        for name, kind in cls.ARRAYS:
            count = n if name in ("hot", "holders", "lengths") else held
            arrays[name] = np.frombuffer(raw, kind, count, at)
            at += arrays[name].nbytes
        ends = (at + np.cumsum(arrays["lengths"], dtype=np.int64)).tolist()
        return cls([raw[i:j] for i, j in zip([at, *ends], ends, strict=False)], **arrays)


_HOLDER = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("first", "<i4")])


def _super_k_mers(docs: DataFrame, k: int, hot: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """(bucket, parcel): the super-k-mers of some documents that go to one bucket. Equal strings are added up before they are shuffled."""
    minimisers, windows = hot

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        held: dict[bytes, list] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            strings, (key, hot_, raw) = list(held), zip(*held.values(), strict=True)
            held.clear()
            key = np.array(key, dtype=np.uint64)
            order = np.argsort(key)
            bucket = _bucket(key[order], buckets)
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
            made = []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                some = order[i:j].tolist()
                mine = [raw[x] for x in some]
                holders = np.frombuffer(b"".join(mine), dtype=_HOLDER)
                n = np.fromiter(map(len, mine), dtype=np.int64, count=len(mine)) // _HOLDER.itemsize
                text = [strings[x] for x in some]
                made.append(_Parcel(text, hot=np.array([hot_[x] for x in some]), holders=n, lengths=np.fromiter(map(len, text), dtype=np.int64, count=len(text)), docs=holders["doc"], tags=holders["tag"], firsts=holders["first"]).packed(squeeze))
            for at in range(0, len(made), 256):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]][at : at + 256]), pa.array(made[at : at + 256], pa.binary())], names=["bucket", "parcel"])

        for batch in sliced(batches):
            ids, tags = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for base, texts in blocks(t.encode() for t in batch.column(2).to_pylist()):
                cut = _Cut(texts, k)
                if not len(cut.at):
                    continue
                key = cut.keys()
                alone = _member(key, minimisers)
                key[alone] = cut.hashes(np.flatnonzero(alone))
                # a super-k-mer begins with a text, a new key, or next to a window that travels alone
                new = np.ones(len(key), dtype=bool)
                new[1:] = (cut.first[1:] == 0) | (key[1:] != key[:-1]) | alone[1:] | alone[:-1]
                starts = np.flatnonzero(new)
                lengths = np.diff(np.append(starts, len(key)))
                if lengths.max() > LONGEST:
                    starts = np.flatnonzero((np.arange(len(key)) - np.repeat(starts, lengths)) % LONGEST == 0)
                    lengths = np.diff(np.append(starts, len(key)))
                text, first = cut.text[starts], cut.first[starts]
                holders = np.empty(len(starts), dtype=_HOLDER)
                holders["doc"], holders["tag"], holders["first"] = ids[base + text], tags[base + text], first
                raw, each = holders.tobytes(), _HOLDER.itemsize
                hots = alone[starts] & _member(key[starts], windows)
                with np.errstate(over="ignore"):
                    order = mix(key[starts])  # minimisers are small hashes; buckets go by ones that are even
                words, now, at = [], -1, 0
                for t, f, n, y, h in zip(text.tolist(), first.tolist(), lengths.tolist(), order.tolist(), hots.tolist(), strict=True):
                    if t != now:
                        words, now = texts[t].split(), t  # bytes split where words do
                    p = b" ".join(words[f : f + n + k - 1])
                    x = held.get(p)
                    own = raw[at : at + each]
                    at += each
                    if x is None:
                        held[p] = [y, h, own]
                        size += len(p) + 300
                    elif h:
                        both = np.frombuffer(x[2] + own, dtype=_HOLDER)
                        x[2] = both[[both["doc"].argmin(), both["doc"].argmax()]].tobytes()
                    else:
                        x[2] += own
                        size += each
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    return docs.where(F.col("doc").isNotNull()).select("doc", "tag", "text").mapInArrow(pack, "bucket long, parcel binary")


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_RANGE = "doc long, tag long, first int, n int, window long"
_NAMES = ["doc", "tag", "first", "n", "window"]


def _judged(parcels: DataFrame, k: int) -> DataFrame:
    """(doc, tag, first, n): so many windows of a document from word ``first`` on stand in a smaller document, too. Rows with ``window`` give a hot window's hash and its least document instead."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        spread = zstandard.ZstdDecompressor().decompress
        open_, bucket = [], None
        for big in batches:
            for b in (big.slice(at, 64) for at in range(0, big.num_rows, 64)):
                for y, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if y != bucket and open_:
                        yield from _resolve([_Parcel.of(spread(x)) for x in open_], k)
                        open_ = []
                    bucket = y
                    open_.append(raw)
        if open_:
            yield from _resolve([_Parcel.of(spread(x)) for x in open_], k)

    return parcels.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(judge, _RANGE)


def _windows(strings: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first word, hash) of all windows."""
    parts = [(cut.text + base, cut.first, cut.hashes(np.arange(len(cut.at)))) for base, some in blocks(strings) for cut in (_Cut(some, k),)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _least_documents(strings: list[bytes], text: np.ndarray, first: np.ndarray, h: np.ndarray, low: np.ndarray, k: int) -> np.ndarray:
    """Of each window, the least document that holds it. Windows are sorted by hash; equal hashes are compared word by word."""
    order = np.argsort(h, kind="stable")
    ordered, mine = h[order], low[text]
    begins = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    n = np.diff(np.append(begins, len(h)))
    best = np.empty(len(h), dtype=np.int64)
    best[order] = np.repeat(np.minimum.reduceat(mine[order], begins), n)
    split: dict[int, list[bytes]] = {}

    def spelt(w: int) -> list[bytes]:
        t = int(text[w])
        if (words := split.get(t)) is None:
            words = split[t] = strings[t].split(b" ")
        return words[first[w] : first[w] + k]

    several = np.flatnonzero(n > 1)
    for at, many in zip(begins[several].tolist(), n[several].tolist(), strict=True):
        members = order[at : at + many].tolist()
        head = spelt(members[0])
        if any(spelt(w) != head for w in members[1:]):  # one hash, several windows
            own: dict[bytes, int] = {}
            for w in members:
                s = b" ".join(spelt(w))
                own[s] = min(own.get(s, int(mine[w])), int(mine[w]))
            for w in members:
                best[w] = own[b" ".join(spelt(w))]
    return best


def _resolve(parcels: list[_Parcel], k: int) -> Iterator[pa.RecordBatch]:
    """A whole bucket, to rows of :data:`_RANGE`."""
    by: dict[bytes, int] = {}
    of = np.fromiter((by.setdefault(p, len(by)) for x in parcels for p in x.strings), dtype=np.int64)
    strings = list(by)
    hot, held, docs, tags, firsts = (np.concatenate([getattr(x, name) for x in parcels]) for name in ("hot", "holders", "docs", "tags", "firsts"))
    begins = np.cumsum(held, dtype=np.int64) - held
    low, high = np.full(len(strings), np.iinfo(np.int64).max), np.full(len(strings), np.iinfo(np.int64).min)
    np.minimum.at(low, of, np.minimum.reduceat(docs, begins))
    np.maximum.at(high, of, np.maximum.reduceat(docs, begins))
    text, first, h = _windows(strings, k)
    best = _least_documents(strings, text, first, h, low, k)
    repeated = np.bincount(text, weights=best < high[text], minlength=len(strings)) > 0
    ends = np.searchsorted(text, np.arange(len(strings) + 1))
    told = np.flatnonzero(repeated[of] & (hot == 1))
    if len(told):
        window = ends[:-1][np.unique(of[told])]
        yield pa.RecordBatch.from_arrays([pa.array(best[window]), pa.nulls(len(window), pa.int64()), *(pa.nulls(len(window), pa.int32()) for _ in range(2)), pa.array(h[window].view(np.int64))], names=_NAMES)
    # each holder with each window of its string; runs of windows that a smaller document holds are ranges
    which = np.repeat(np.where(hot == 1, -1, of), held)
    some = np.flatnonzero((which >= 0) & repeated[which])
    which, docs, tags, firsts = which[some], docs[some], tags[some], firsts[some]
    for at in range(0, len(which), 100_000):
        yield _ranges(which[at : at + 100_000], docs[at : at + 100_000], tags[at : at + 100_000], firsts[at : at + 100_000], ends, best)


def _ranges(which: np.ndarray, docs: np.ndarray, tags: np.ndarray, firsts: np.ndarray, ends: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    n = np.diff(ends)[which]
    holder = np.repeat(np.arange(len(which)), n)
    place = np.arange(int(n.sum())) - (np.cumsum(n) - n)[holder]
    taken = best[ends[which][holder] + place] < docs[holder]
    opens = taken & ((place == 0) | ~np.append(False, taken[:-1]))
    closes = taken & (np.append(place[1:] == 0, True) | ~np.append(taken[1:], False))
    a, z = np.flatnonzero(opens), np.flatnonzero(closes)
    own = holder[a]
    return pa.RecordBatch.from_arrays([pa.array(docs[own]), pa.array(tags[own]), pa.array((firsts[own] + place[a]).astype(np.int32)), pa.array((z - a + 1).astype(np.int32)), pa.nulls(len(a), pa.int64())], names=_NAMES)


def _freed(df: DataFrame, name: str) -> DataFrame:
    """:func:`staged`, after which the shuffle files of its job go, where Spark can do that."""
    spark, setting = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        return staged(df, name)
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def _tagged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, tag, text): rows that share their key with others have a hash of their text as tag, so that places in their texts stay apart."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), text_of(text).alias("text"))
    several = staged(rows.where("doc is not null").groupBy("doc").agg(F.count("*").alias("rows")).where("rows > 1").select("doc", F.lit(True).alias("shared")), "shared-keys", 100_000)
    n = several.count()
    if not n:
        return rows.select("doc", F.lit(0).cast("long").alias("tag"), "text")
    if n <= 100_000:
        several = F.broadcast(several)
    return rows.join(several, "doc", "left").select("doc", F.when(F.col("shared"), F.xxhash64("text")).otherwise(0).alias("tag"), "text")


def remove_repeats(docs: DataFrame, k: int = 13, key: str = "doc_id", text: str = "text", hot_share: float = 1e-5) -> DataFrame:
    """(key, n_words, n_removed, kept): each row's text without the words of windows that also start in a row with a smaller key.

    A window is ``k`` consecutive words (split at bytes 0x20 and 0x09-0x0D) of one row. Windows are judged on the input. Kept words
    are joined by one space. A null text is empty and has no words; rows with a null key neither lose words nor take any; rows
    with equal keys take none from each other; keys are whole numbers; an empty table gives no rows; other columns are ignored.

    Texts are read three times: hot minimisers are counted, super-k-mers dealt out, and words removed. A bucket, which is held in
    memory, has about :data:`BUCKET` windows and what one minimiser holds, ``2 * hot_share`` of all windows at most: lower it for very
    large inputs.
    """
    rows = _tagged(docs, key, text)
    *hot, total = _hot(rows, k, hot_share)
    buckets = max(total // BUCKET, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = _freed(_judged(_super_k_mers(rows, k, hot, buckets), k), "repeated-windows")
    answers = ranges.where("window is not null").groupBy("window").agg(F.min("doc").alias("doc")).toPandas().sort_values("window") if len(hot[1]) else None  # at most 1 / hot_share
    told = (answers["window"].to_numpy(np.int64), answers["doc"].to_numpy(np.int64)) if answers is not None and len(answers) else None
    packed = F.shiftleft(F.col("first").cast("long"), 8) + F.col("n")  # n is at most LONGEST
    of = ranges.where("window is null").groupBy("doc", "tag").agg(F.collect_set(packed).alias("ranges"))
    both = rows.join(of.hint("shuffle_hash"), ["doc", "tag"], "left").select("doc", "text", "ranges")
    minimisers = hot[0]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, ids = batch.num_rows, batch.column(0).to_pylist()
            words_of, removed, kept = np.zeros(n, np.int64), np.zeros(n, np.int64), []
            ranges_of = batch.column(2).to_pylist()
            for base, texts in blocks(t.encode() for t in batch.column(1).to_pylist()):
                more: dict[int, list[int]] = {}  # hot windows, by text
                if told is not None:
                    cut = _Cut(texts, k)
                    at = np.flatnonzero(_member(cut.keys(), minimisers))
                    h = cut.hashes(at).view(np.int64)
                    place = np.minimum(np.searchsorted(told[0], h), len(told[0]) - 1)
                    for t, f, w in zip(cut.text[at].tolist(), cut.first[at].tolist(), np.where(told[0][place] == h, told[1][place], np.iinfo(np.int64).max).tolist(), strict=True):
                        if ids[base + t] is not None and w < ids[base + t]:
                            more.setdefault(t, []).append(f << 8 | 1)
                for t, x in enumerate(texts):
                    words, taken = x.split(), [*(ranges_of[base + t] or ()), *more.get(t, ())]
                    words_of[base + t] = len(words)
                    if taken:
                        r = np.array(taken, dtype=np.int64)
                        depth = np.bincount(r >> 8, minlength=len(words) + 1) - np.bincount((r >> 8) + (r & 255) - 1 + k, minlength=len(words) + 1)
                        gone = np.cumsum(depth[:-1]) > 0
                        removed[base + t] = gone.sum()
                        words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                    kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of), pa.array(removed), pa.array(kept, pa.string())], names=["doc", "n_words", "n_removed", "kept"])

    return both.mapInArrow(keep, "doc long, n_words long, n_removed long, kept string").withColumnRenamed("doc", key)
