"""Near-duplicate join: documents whose sets of word n-grams have a Jaccard similarity of at least a threshold.

Documents with equal sets are one class, so copies are never compared. The classes' MinHash signatures are cut into
bands; classes that share a band's hash (a bucket) meet in a shuffle on it, and each such pair, and no other, is verified
once on the full sets. Buckets of few sets give pairs. In larger ones blocks of sets meet, and matrix products find the
links, which leave as link counts and a spanning forest instead of pairs; a pair that meets in several large buckets
counts in the first. How large a bucket must be for that changes nothing in the result. Band and row counts follow
from the recall asked for at the threshold: a pair there is missed with probability ``(1 - threshold ** rows) ** bands``,
more similar ones far less often.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.shared import bit_map, blocks, combine, fresh, in_bit_map, join_counted, mix, row_keys, sliced, staged, text_of, word_hashes

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9995


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective rows whose bands reach ``recall`` within ``most`` hashes."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log1p(-recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= most:
            return bands, rows
    raise ValueError(f"no {most} hashes find pairs of similarity {threshold} with recall {recall}")


def shingle_sets(texts: list[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the sorted set of its word n-grams' hashes: lower case, split at white space; of a shorter text all its words are the one n-gram, an empty one has none."""
    for _, some in blocks((t or "").lower().encode("utf-8", "replace") for t in texts):
        hashes, counts = word_hashes(some)
        grams = hashes
        with np.errstate(over="ignore"):
            for k in range(1, words):
                grams = combine(grams[:-1], hashes[k:])
            end = 0
            for n in counts.tolist():
                start, end = end, end + n
                if n >= words:
                    yield np.unique(grams[start : end - words + 1])
                elif n:
                    one = hashes[start : start + 1]
                    for h in hashes[start + 1 : end]:
                        one = combine(one, np.array([h]))
                    yield one
                else:
                    yield np.zeros(0, dtype=np.uint64)


class BandHasher:
    """Hashes of a set's bands: each of ``rows`` minima under universal hash functions."""

    def __init__(self, bands: int, rows: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            low = None
            for i in range(0, len(grams), 4096):
                x = grams[i : i + 4096]
                y = np.array([((x * a + b) >> np.uint64(32)).min() for a, b in zip(self.a, self.b, strict=True)], dtype=np.uint64)
                low = y if low is None else np.minimum(low, y)
            by_band = low.reshape(self.bands, self.rows)
            out = np.arange(1, self.bands + 1, dtype=np.uint64)
            for r in range(self.rows):
                out = combine(out, by_band[:, r])
            return out


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, key, set_a, set_b, grams, bands) of ``docs`` (id, key, text): a 128-bit hash of the set, its size, its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = BandHasher(bands, rows)
        for batch in sliced(batches):
            a, b, n, band = [], [], [], []
            for grams in shingle_sets(batch.column(2).to_pylist(), words):
                with np.errstate(over="ignore"):
                    a.append(mix(grams).sum(dtype=np.uint64))
                    b.append(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                n.append(len(grams))
                band.append(hasher(grams).view(np.int64) if len(grams) else None)
            offsets = np.concatenate(([0], np.cumsum([0 if x is None else bands for x in band])))
            values = np.concatenate([x for x in band if x is not None]) if any(x is not None for x in band) else np.zeros(0, dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(a, dtype=np.uint64).view(np.int64)), pa.array(np.array(b, dtype=np.uint64).view(np.int64)), pa.array(n, pa.int64()), lists], names=["id", "key", "set_a", "set_b", "grams", "bands"])

    return docs.mapInArrow(run, "id long, key long, set_a long, set_b long, grams long, bands array<long>")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b); only nodes with an edge.

    Alternating large and small stars (Kiveris and others): every round ties each node to the smallest one in its
    neighbourhood, so the rounds grow with the logarithm of the longest path. Each round is staged, and no link or
    component comes to the driver, only a count and a checksum. Hubs are joined where their links are.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    at = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    at = staged(at.distinct(), name, at.count())
    was = mark(at)
    while was[0]:
        both = at.union(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = staged(both.groupBy("a").agg(F.min("b").alias("_low"), F.count("*").alias("_n")), name, 2 * was[0]).withColumn("_low", F.least("a", "_low"))
        large = join_counted(both, low, ["a"], "_n").where("b > a").select(F.col("_low").alias("a"), "b").distinct()
        large = staged(large, name, was[0])
        # small star: b's neighbours below it, and b itself, are tied to the smallest of them
        low = staged(large.groupBy("b").agg(F.min("a").alias("_low"), F.count("*").alias("_n")), name, was[0])
        small = join_counted(large, low, ["b"], "_n").where("a > _low").select(F.col("_low").alias("a"), F.col("a").alias("b"))
        at = staged(small.union(low.select(F.col("_low").alias("a"), "b")).distinct(), name, 2 * was[0])
        now = mark(at)
        if now == was:
            break
        was = now
    return at.select(F.col("b").alias("node"), F.col("a").alias("component")).union(at.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def gram_sets(texts: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(id, grams) of the ``texts`` (id, text) whose id is among ``ids``, and perhaps of a few more; grams: sorted hashes.

    A bit map of the ids (16 MB at most, 1 in 8 bits set) goes to the tasks, and texts are not shuffled. Where it does not
    hold them, texts and ids are joined by shuffle.
    """
    ids = ids.select("id").distinct()
    seen, place = bit_map(ids, "id")
    if seen is None:
        texts = texts.join(ids, "id", "left_semi")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            if seen is not None:
                b = b.filter(pa.array(in_bit_map(seen, b.column(2).to_numpy())))
            sets = list(shingle_sets(b.column(1).to_pylist(), words))
            offsets = np.concatenate(([0], np.cumsum([len(g) for g in sets])))
            values = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=["id", "grams"])

    return texts.select("id", "text", place.alias("_place")).mapInArrow(to_sets, "id long, grams array<long>")


def verified_pairs(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Of ``pairs`` (a, b) of ids those whose ``sets`` (id, grams) reach ``threshold``, with the similarity. Two sets at a time are compared, where the rows are."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("grams").alias("_x")), "a")
    full = left.join(sets.select(F.col("id").alias("b"), F.col("grams").alias("_y")), "b")
    n, m = F.size("_x"), F.size("_y")
    full = full.where(F.least(n, m) >= threshold * F.greatest(n, m)).select("a", "b", (n + m).alias("_both"), F.size(F.array_intersect("_x", "_y")).alias("_common"))
    return full.select("a", "b", (F.col("_common") / (F.col("_both") - F.col("_common"))).alias("jaccard")).where(F.col("jaccard") >= threshold)


def similarities(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Jaccard similarities of all ``left`` with all ``right`` sets, by products of 0/1 matrices over the grams that both sides have, ``width`` grams at a time."""
    grams = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    distinct, column = np.unique(grams, return_inverse=True)
    on_left = row < len(left)
    shared = (np.bincount(column[on_left], minlength=len(distinct)) > 0) & (np.bincount(column[~on_left], minlength=len(distinct)) > 0)
    new = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], new[column[keep]]
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        m = np.zeros((len(left) + len(right), width), dtype=np.float32)
        m[row[a:b], column[a:b] - lo] = 1
        common += m[: len(left)] @ m[len(left) :].T
    sizes = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right])[None, :]
    return common / np.maximum(sizes - common, 1)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric 0/1 matrix."""
    left = np.ones(len(linked), dtype=bool)
    edges = []
    for root in range(len(linked)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            x = queue.pop()
            new = np.flatnonzero(linked[x] & left)
            left[new] = False
            edges += [(x, int(y)) for y in new]
            queue += new.tolist()
    return edges


def blocked_links(members: DataFrame, sets: DataFrame, threshold: float, bands: int, block: int = 256, most_block: int = 1024, most_grams: int = 500_000) -> DataFrame:
    """Links of sets that share a large bucket: ``members`` (id, band, hash, n) in ``sets`` (id, copies, grams).

    A bucket is cut into blocks by hash, and each two of its blocks meet in one group. A group gives a row
    (a, null, null, n) for each set with the copies of what it is linked to there, and rows (a, b, jaccard, null) that
    connect what is linked. A pair counts in the first of its common large buckets only. Blocks hold about ``most_block``
    sets and ``most_grams`` grams at most, so a group's memory is bounded whatever the bucket.
    """
    mine = members.groupBy("id").agg(F.collect_list(F.struct("band", "hash")).alias("own"))  # one for each band at most
    # the bucket of each band, 0 where that is small; hashes are never 0 in practice, and a 0 would only be compared once more
    own = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.coalesce(F.get(F.filter("own", lambda o: o["band"] == k), 0)["hash"], F.lit(0)))
    about = staged(mine.select("id", own.alias("own")).join(sets, "id").withColumn("_len", F.size("grams")), "block-sets", 8 * members.count())
    each = members.join(about.select("id", "_len"), "id").groupBy("band", "hash").agg(F.max("_len").alias("_most"), F.count("*").alias("n"))
    each = each.withColumn("_each", F.least(F.greatest(F.ceil(F.col("n") / 64), F.lit(block)), F.lit(most_block), F.greatest(F.floor(most_grams / F.greatest("_most", F.lit(1))), F.lit(1))))
    each = staged(each.select("band", "hash", "n", F.ceil(F.col("n") / F.col("_each")).cast("int").alias("_blocks")), "block-sizes", members.count())
    dealt = join_counted(members.select("id", "band", "hash"), each, ["band", "hash"], "n")
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("id", "band"), F.col("_blocks")).cast("int")).join(about, "id")
    met = F.explode(F.transform(F.sequence(F.lit(0), F.col("_blocks") - 1), lambda j: F.struct(F.least(j, F.col("_own")).alias("p"), F.greatest(j, F.col("_own")).alias("q"))))
    dealt = dealt.select("id", "band", "hash", "_own", "copies", "own", "grams", met.alias("_m")).select("band", "hash", "_m.p", "_m.q", "id", "_own", "copies", "own", "grams")

    def meet(group: pa.Table) -> pa.Table:
        ids, copies, side = (group.column(c).to_numpy() for c in ("id", "copies", "_own"))
        p, q, band = (group.column(c)[0].as_py() for c in ("p", "q", "band"))
        lists = group.column("grams").combine_chunks()
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy().view(np.uint64)
        grams = [values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
        a, b = np.flatnonzero(side == p), np.flatnonzero(side == q)
        # pairs that share a large bucket of an earlier band are counted there
        fresh_ = np.ones((len(a), len(b)), dtype=bool)
        buckets = group.column("own").combine_chunks().flatten().to_numpy().reshape(-1, bands)
        for k in range(band):
            fresh_ &= (buckets[a, k][:, None] != buckets[b, k][None, :]) | (buckets[a, k] == 0)[:, None]
        if p == q:
            np.fill_diagonal(fresh_, False)
        link = np.zeros_like(fresh_)
        s = link.astype(np.float32)
        rows, cols = np.flatnonzero(fresh_.any(1)), np.flatnonzero(fresh_.any(0))
        if len(rows):
            part = similarities([grams[i] for i in a[rows]], [grams[i] for i in b[cols]])
            s[np.ix_(rows, cols)] = part
            link = (s >= np.float32(threshold)) & fresh_
            for i, j in np.argwhere((np.abs(s - threshold) < 1e-5) & fresh_):  # float32 decides all but those
                common = len(np.intersect1d(grams[a[i]], grams[b[j]], assume_unique=True))
                link[i, j] = common >= threshold * (len(grams[a[i]]) + len(grams[b[j]]) - common) - 1e-9
        full = np.zeros((len(ids), len(ids)), dtype=bool)
        full[np.ix_(a, b)] = link
        full |= full.T
        n = full @ copies
        got = np.flatnonzero(n)
        edges = forest(full)
        value = {}
        if edges:
            at_a, at_b = {int(x): i for i, x in enumerate(a)}, {int(x): i for i, x in enumerate(b)}
            value = {(x, y): float(s[at_a[x], at_b[y]] if x in at_a and y in at_b else s[at_a[y], at_b[x]]) for x, y in edges}
        k = len(got)
        return pa.table({
            "a": pa.array([*ids[got].tolist(), *[int(min(ids[x], ids[y])) for x, y in edges]], pa.int64()),
            "b": pa.array([None] * k + [int(max(ids[x], ids[y])) for x, y in edges], pa.int64()),
            "jaccard": pa.array([None] * k + [value[e] for e in edges], pa.float64()),
            "n": pa.array([*n[got].tolist()] + [None] * len(edges), pa.int64()),
        })

    return dealt.groupBy("band", "hash", "p", "q").applyInArrow(meet, "a long, b long, jaccard double, n long")


def join(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "doc_id", text: str = "text", small: int = 8) -> tuple[DataFrame, DataFrame]:
    """(documents, links).

    documents: a row for each of ``docs``: key, class_id (the smallest key of its group of linked documents), set_id
    (the smallest key with the same n-gram set), n_links (other documents of at least ``threshold``, copies counted, over
    all links). links: verified (a, b, jaccard) between set_ids that connect each group: all links of small buckets, of
    large ones a spanning forest for each two blocks.

    ``key`` is a whole number. Rows without one, and those whose key several texts have, go by a negative id instead.
    A null text is empty; empty texts are copies of each other and of nothing else. Repeated rows are copies. An empty table
    gives none; other columns are ignored. A group of copies of any size is one row before any join. ``small`` decides
    only where pairs are verified (one by one, or in blocks), not which: pairs of sets that share a band.
    """
    bands, rows = choose_bands(threshold, recall)
    (id_,) = fresh(docs, "_id")
    keyed = row_keys(docs, id_, key, text)
    texts = keyed.select(F.col(id_).alias("id"), F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    sketches = staged(sketch(texts, words, bands, rows), "sketches")
    sets = staged(sketches.groupBy("set_a", "set_b").agg(F.min("id").alias("set_id"), F.count("*").alias("copies"), F.any_value("bands").alias("bands")), "sets", sketches.count())
    n_sets = sets.count()
    banded = sets.select(F.col("set_id").alias("id"), F.posexplode("bands").alias("band", "hash"))
    sizes = staged(banded.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes", n_sets)
    n_met = sizes.agg(F.sum("n")).first()[0] or 0
    met = staged(join_counted(banded, sizes, ["band", "hash"], "n"), "buckets", n_met)
    large = met.where(F.col("n") > small)
    x, y = met.where(F.col("n") <= small).alias("x"), met.where(F.col("n") <= small).alias("y")
    same = (F.col("x.hash") == F.col("y.hash")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id"))
    pairs = x.join(y, same).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    # pairs that share a large bucket are counted there
    of = large.groupBy("id").agg(F.collect_list(F.struct("band", "hash")).alias("_of"))
    of_a, of_b = (of.select(F.col("id").alias(c), F.col("_of").alias(f"_{c}")) for c in "ab")
    pairs = pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(~F.coalesce(F.arrays_overlap("_a", "_b"), F.lit(False)))
    pairs = staged(pairs.select("a", "b"), "candidates", n_met)
    # a set's text is that of a row with its id
    members = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).union(large.select("id"))
    grams = staged(gram_sets(texts, members, words).dropDuplicates(["id"]), "gram-sets")
    sized = sets.select(F.col("set_id").alias("id"), "copies")
    blocked = staged(blocked_links(large, sized.join(grams, "id"), threshold, bands), "blocked-links")
    single = staged(verified_pairs(grams, pairs, threshold), "links")
    links = single.union(blocked.where("b is not null").select("a", "b", "jaccard"))
    grouped = components(links.select("a", "b"))
    ends = single.select(F.col("a").alias("set_id"), F.col("b").alias("id")).union(single.select(F.col("b").alias("set_id"), F.col("a").alias("id")))
    counted = ends.join(sized, "id").select("set_id", F.col("copies").alias("n")).union(blocked.where("b is null").select(F.col("a").alias("set_id"), "n"))
    linked = counted.groupBy("set_id").agg(F.sum("n").alias("_linked"))
    about = sets.select("set_a", "set_b", "set_id", "copies").join(linked, "set_id", "left").join(grouped.withColumnRenamed("node", "set_id"), "set_id", "left")
    about = about.select("set_a", "set_b", "set_id", F.coalesce("component", "set_id").alias("class_id"), "copies", (F.col("copies") - 1 + F.coalesce("_linked", F.lit(0))).cast("long").alias("n_links"))
    about = staged(about, "set-classes", n_sets)
    return join_counted(sketches.select(F.col("key").alias(key), "set_a", "set_b"), about, ["set_a", "set_b"], "copies").select(key, "class_id", "set_id", "n_links"), links
