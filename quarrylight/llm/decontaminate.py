"""Benchmark decontamination by spaced seeds: masks that ignore some positions survive substituted tokens.

A seed hashes the tokens that a mask keeps in a window. Documents' and items' seeds meet by equality; around each hit
the document is compared with the whole item on the hit's diagonal, substitutions allowed. An item's matched tokens over
all diagonals (an insertion moves to another one) decide.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.shared import bit_map, blocks, combine, in_bit_map, mix, sliced, staged, text_of, word_hashes

#: Windows of tokens; a 0 is ignored. Each keeps five tokens.
MASKS = ("1101101", "110100011", "1001010101")
#: One more mask, of four tokens, for items under so many tokens, in which few windows of the others have room.
SHORT_MASK, SHORT_ITEM = "11011", 20
#: Items whose seeds fit in this many rows go to every task; more are joined by shuffle.
MOST_IN_MEMORY = 2_000_000
_PLAIN = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def token_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    """For each text its tokens' hashes: lower case, ASCII punctuation and white space between tokens."""
    for _, some in blocks((t or "").lower().encode("utf-8", "replace").translate(_PLAIN) for t in texts):
        hashes, counts = word_hashes(some)
        end = 0
        for n in counts.tolist():
            start, end = end, end + n
            yield hashes[start:end]


def seeds(tokens: np.ndarray, masks: tuple[str, ...] = MASKS, item: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, hashes) for each mask, and for short texts (below the shortest mask) all tokens as one. Of an ``item`` that is not short, the short mask is left out."""
    shortest = min(map(len, masks))
    with np.errstate(over="ignore"):
        if 0 < len(tokens) < shortest:
            one = np.array([len(tokens)], dtype=np.uint64)
            for t in tokens:
                one = combine(one, np.array([t]))
            yield np.zeros(1, dtype=np.int64), mix(one)
        used = masks if item and (len(tokens) >= SHORT_ITEM or len(tokens) < shortest) else (*masks, SHORT_MASK)
        for i, mask in enumerate(used):
            if (n := len(tokens) - len(mask) + 1) > 0:
                h = np.full(n, i + 101, dtype=np.uint64)
                for k, bit in enumerate(mask):
                    if bit == "1":
                        h = combine(h, tokens[k : k + n])
                yield np.arange(n), h


def short_windows(tokens: np.ndarray, lengths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows that could be a whole item of one of ``lengths`` (below the shortest mask)."""
    with np.errstate(over="ignore"):
        for n in lengths:
            if len(tokens) >= n:
                h = np.full(len(tokens) - n + 1, n, dtype=np.uint64)
                for k in range(n):
                    h = combine(h, tokens[k : len(tokens) - n + 1 + k])
                yield np.arange(len(h)), mix(h)


def runs(same: np.ndarray, mismatch: float, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the best run, and of the best ones left and right of it, as long as they hold ``least`` equal tokens. An equal token counts 1, another one ``-mismatch``."""
    upto = np.concatenate(([0], np.cumsum(same)))
    sums = upto * (1 + mismatch) - mismatch * np.arange(len(upto))
    parts = [(0, len(same))]
    while parts:
        lo, hi = parts.pop()
        if upto[hi] - upto[lo] < least:
            continue
        here = sums[lo : hi + 1]
        drop = here - np.minimum.accumulate(here)
        end = int(drop.argmax())
        start = int(here[: end + 1].argmin()) if end else 0
        if upto[lo + end] - upto[lo + start] < least:
            # the best one is too short, so that others score less, but may hold more equal tokens
            if end > start:
                parts += [(lo, lo + start), (lo + end, hi)]
            continue
        yield lo + start, lo + end
        parts += [(lo, lo + start), (lo + end, hi)]


def matched(doc: np.ndarray, item: np.ndarray, diagonals, mismatch: float = 1.5, least: int = 4, alone: float = 0.5) -> tuple[int, int, int]:
    """(item tokens matched, first and last document token). On a diagonal that holds ``alone`` of the item's tokens or more, all equal ones count, however they are strewn. On the others the best runs that don't overlap do, with +1 for an equal token and ``-mismatch`` for another; runs under ``least`` equal tokens don't, as chance would add up over diagonals."""
    got = np.zeros(len(item), dtype=bool)
    first, last = len(doc), -1
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        if hi <= lo:
            continue
        same = item[lo:hi] == doc[lo + d : hi + d]
        equal = np.flatnonzero(same)
        if len(equal) >= max(alone * len(item), 1):
            got[lo + equal] = True
            first, last = min(first, lo + d + int(equal[0])), max(last, lo + d + int(equal[-1]))
            continue
        for start, end in runs(same, mismatch, min(least, len(item))):
            got[lo + start : lo + end] |= same[start:end]
            first, last = min(first, lo + d + start), max(last, lo + d + end - 1)
    return int(got.sum()), first, last


class Items:
    """The benchmark in memory: token hashes of each item and a table of seeds behind a bit map."""

    def __init__(self, ids: list, tokens: list[np.ndarray], masks: tuple[str, ...], bits: int = 24):
        self.ids, self.tokens, self.masks = ids, tokens, masks
        self.short = sorted({len(t) for t in tokens if 0 < len(t) < min(map(len, masks))})
        h, item, place = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, t in enumerate(tokens):
            for at, x in seeds(t, masks, item=True):
                h.append(x)
                item.append(np.full(len(x), i))
                place.append(at)
        hashes = np.concatenate(h)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.place = hashes[order], np.concatenate(item)[order], np.concatenate(place)[order]
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, dtype=bool)
        self.seen[(self.hashes >> self.shift).astype(np.int64)] = True

    def hits(self, doc: np.ndarray) -> dict[int, set[int]]:
        """Item number: diagonals with a hit."""
        out: dict[int, set[int]] = {}
        windows = [*seeds(doc, self.masks), *short_windows(doc, self.short)]
        for places, h in windows:
            some = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
            if not len(some):
                continue
            lo, hi = np.searchsorted(self.hashes, h[some], "left"), np.searchsorted(self.hashes, h[some], "right")
            for i in np.flatnonzero(hi > lo):
                at = int(places[some[i]])
                for k in range(lo[i], hi[i]):
                    out.setdefault(int(self.item[k]), set()).add(at - int(self.place[k]))
        return out


def judge(doc: np.ndarray, item: np.ndarray, diagonals, least_share: float, least_tokens: int, least_within: int) -> tuple[int, int, int] | None:
    """What matched, if it is enough. An item of just ``least_tokens`` may lack a fifth of them; one under ``least_tokens`` must be there word by word, and one under ``least_within`` must be the whole document."""
    if len(item) >= least_tokens:
        n, first, last = matched(doc, item, diagonals, alone=least_share)
        return (n, first, last) if n >= max(least_share * len(item), min(least_tokens, 0.8 * len(item))) else None
    if len(item) != len(doc) and len(item) < least_within:
        return None
    places = [d for d in diagonals if 0 <= d <= len(doc) - len(item) and (doc[d : d + len(item)] == item).all()]
    return (len(item), min(places), min(places) + len(item) - 1) if places else None


_OUT = "{key} {kind}, item_id long, matched_tokens long, item_tokens long, coverage double, first_token long, last_token long"


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", masks: tuple[str, ...] = MASKS, least_share: float = 0.5, least_tokens: int = 8, least_within: int = 8, most_in_memory: int = MOST_IN_MEMORY) -> DataFrame:
    """A row for each document and item of which it holds ``least_share`` of the tokens (and ``least_tokens`` at least, or four
    in five of a shorter item's), if one of the masks hits: five tokens as they are, at the mask's distances. README has the
    recall that follows for tokens replaced at random places.

    Columns: key, item_id, matched_tokens, item_tokens, coverage, first_token, last_token (token places in the
    document). Whole texts are searched. An item under ``least_tokens`` is reported where all its tokens stand in a row;
    under ``least_within`` tokens only where they are the whole document, since a few common words say little within a
    longer one. A null text is empty, empty texts and items match nothing, equal items are
    reported each, repeated documents too, rows without a key or item_id like others; an empty table on either side
    gives no rows; other columns are ignored.

    The benchmark goes to every task only if its tokens' seeds by ``masks`` are at most ``most_in_memory`` (short items have a third more);
    beyond that documents' and items' seeds are joined by shuffle, with the same result.
    """
    items = benchmark.select(F.col(item).cast("long").alias("item_id"), text_of(item_text).alias("_item"))
    # tokens stand between white space and ASCII punctuation; each starts a window of each mask at most
    tokens = items.agg(F.sum(F.size(F.split("_item", r"[\s\p{Punct}]+")))).first()[0] or 0
    schema = _OUT.format(key=key, kind=docs.schema[key].dataType.simpleString())
    own = docs.select(F.col(key), text_of(text).alias("_text"))
    if tokens * len(masks) <= most_in_memory:
        rows = items.collect()  # bounded just above
        held = Items([r["item_id"] for r in rows], list(token_hashes([r["_item"] for r in rows])), masks)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                out = []
                for row, doc in enumerate(token_hashes(batch.column(1).to_pylist())):
                    for i, diagonals in held.hits(doc).items():
                        if found := judge(doc, held.tokens[i], diagonals, least_share, least_tokens, least_within):
                            n = len(held.tokens[i])
                            out.append((row, held.ids[i], found[0], n, found[0] / n, found[1], found[2]))
                yield _batch(batch.column(0), out, key)

        return own.mapInArrow(search, schema)

    # rows meet by hashes of their own, which are there where a key is null; equal rows share one and are joined each
    own = own.withColumn("_row", F.xxhash64(F.col(key), "_text"))
    items = items.withColumn("_it", F.xxhash64("item_id", "_item"))
    shortest = min(map(len, masks))

    def emit(seen: np.ndarray | None, lengths: list[int], size: int):
        """Seeds of texts: of items all, of documents those that the bit map of ``size`` bits knows, with windows of the short items' ``lengths``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                row, at, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for i, t in enumerate(token_hashes(batch.column(1).to_pylist())):
                    for places, x in [*seeds(t, masks, item=seen is None), *short_windows(t, lengths)]:
                        if seen is not None:
                            known = in_bit_map(seen, (x & np.uint64(size - 1)).astype(np.int64))
                            places, x = places[known], x[known]
                        row.append(np.full(len(x), i))
                        at.append(places)
                        h.append(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(at)), pa.array(np.concatenate(h).view(np.int64))], names=[batch.schema.names[0], "place", "seed"])

        return run

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = {len(t) for t in token_hashes(batch.column(0).to_pylist()) if 0 < len(t) < shortest}
            yield pa.RecordBatch.from_pydict({"n": pa.array(sorted(found), pa.int64())})

    item_seeds = staged(items.select("_it", "_item").distinct().mapInArrow(emit(None, [], 0), "_it long, place long, seed long").withColumnRenamed("place", "_at"), "item-seeds")
    lengths = sorted(r["n"] for r in items.select("_item").mapInArrow(sizes, "n long").distinct().collect())  # below the shortest mask
    seen, size = seed_map(item_seeds)
    doc_seeds = own.select("_row", "_text").mapInArrow(emit(seen, lengths, size), "_row long, place long, seed long")
    hits = doc_seeds.join(item_seeds, "seed").select("_row", "_it", (F.col("place") - F.col("_at")).alias("_d")).distinct()
    hits = staged(hits.groupBy("_row", "_it").agg(F.collect_list("_d").alias("_diagonals")), "seed-hits")  # no more than both texts have places
    # only texts with a hit are joined
    seen_rows, place = bit_map(hits.select("_row").distinct(), "_row")
    if seen_rows is not None:
        columns = own.columns

        def with_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(in_bit_map(seen_rows, b.column("_place").to_numpy()))).select(columns)

        own = own.withColumn("_place", place).mapInArrow(with_hits, own.schema)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            pairs = zip(token_hashes(batch.column(2).to_pylist()), token_hashes(batch.column(3).to_pylist()), strict=True)
            for row, ((doc, it), d, i) in enumerate(zip(pairs, batch.column(4).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if found := judge(doc, it, d, least_share, least_tokens, least_within):
                    out.append((row, i, found[0], len(it), found[0] / len(it), found[1], found[2]))
            yield _batch(batch.column(0), out, key)

    return hits.join(own, "_row").join(items, "_it").select(key, "item_id", "_text", "_item", "_diagonals").mapInArrow(verify, schema)


def seed_map(item_seeds: DataFrame, most_bits: int = 1 << 27) -> tuple[np.ndarray, int]:
    """A bit map of the low bits of all item seeds, 16 MB at most, and its number of bits. However full, it loses no seed."""
    size = min(most_bits, max(1 << 15, 1 << (16 * max(1, item_seeds.count()) - 1).bit_length()))
    bit = F.col("seed").bitwiseAND(F.lit(size - 1))
    marks = item_seeds.select(F.shiftright(bit, 15).alias("_part"), F.pmod(bit, F.lit(1 << 15)).alias("_bit")).groupBy("_part").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    seen = np.zeros(size // 8, dtype=np.uint8)
    for r in marks.collect():  # bounded: 4 KB for each 32768 bits
        seen[r["_part"] << 12 : (r["_part"] + 1) << 12] = np.frombuffer(r["_bits"], dtype=np.uint8)
    return seen, size


def _batch(keys: pa.Array, out: list[tuple], key: str) -> pa.RecordBatch:
    cols = list(zip(*out, strict=True)) or [()] * 7
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([keys.take(pa.array(cols[0], pa.int64())), *[pa.array(c, k) for c, k in zip(cols[1:], kinds, strict=True)]], names=[key, "item_id", "matched_tokens", "item_tokens", "coverage", "first_token", "last_token"])
