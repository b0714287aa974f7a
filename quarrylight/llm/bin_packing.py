"""Best-fit packing with Martello-Toth dominance reduction.

Only the lengths decide how documents are packed, and there are at most ``capacity`` of them. So the histogram of
lengths is solved on the driver, whatever the number of documents: sets that provably dominate every alternative are
fixed in bulk, the rest is packed best-fit decreasing, both by multiplicity. The plan (a few thousand runs at most)
then goes back to the documents, which are numbered within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.shared import numbered, salted, sliced, staged, text_of

CAPACITY = 1024
END_ID = 2
Pattern = tuple[int, ...]


def _fits(counts: list[int], most: int, less: Counter) -> int:
    """The largest length of at most ``most`` of which an item is left beside ``less``; 0 if none."""
    for x in range(most, 0, -1):
        if counts[x] > less[x]:
            return x
    return 0


def _smallest(counts: list[int], less: Counter, n: int) -> list[int]:
    out: list[int] = []
    for x in range(1, len(counts)):
        out += [x] * min(n - len(out), counts[x] - less[x])
        if len(out) == n:
            break
    return out


def _times(counts: list[int], pattern: Pattern) -> int:
    return min(counts[x] // k for x, k in Counter(pattern).items())


def reduce_dominated(counts: list[int]) -> list[tuple[Pattern, int]]:
    """Fix sets that dominate (Martello and Toth), taking their items off ``counts``.

    With ``j`` the longest item left and ``room`` what it leaves: ``{j}`` if nothing fits; ``{j, k}`` if ``k`` fills the
    room, or no two others fit, or at most two others fit and no pair sums to more than ``k``; ``{j, k, b}`` if at most
    two others fit and every pair that fits is below ``(k, b)`` item by item. Removing items keeps each condition, so
    a set is fixed as often as its items last.
    """
    cap, fixed, changed = len(counts) - 1, [], True
    while changed:
        changed = False
        for j in range(cap, 0, -1):
            while counts[j]:
                own, room = Counter([j]), cap - j
                k = _fits(counts, room, own)
                low = _smallest(counts, own, 3)
                pattern: Pattern | None = None
                if not k:
                    pattern = (j,)
                elif k == room or len(low) < 2 or low[0] + low[1] > room:
                    pattern = (j, k)
                elif len(low) < 3 or sum(low) > room:
                    best = least = 0  # the largest sum of a pair that fits; the largest shorter half of one
                    for y in range(1, room // 2 + 1):
                        if counts[y] > own[y] and (x := _fits(counts, room - y, own + Counter([y]))):
                            best, least = max(best, x + y), max(least, min(x, y))
                    b = _fits(counts, room - k, own + Counter([k]))
                    if k >= best:
                        pattern = (j, k)
                    elif b and b >= least:
                        pattern = (j, k, b)
                if pattern is None:
                    break
                times = _times(counts, pattern)
                for x in pattern:
                    counts[x] -= times
                fixed.append((pattern, times))
                changed = True
    return fixed


def best_fit(counts: list[int]) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing by multiplicity: equal open bins are one entry with a count."""
    cap = len(counts) - 1
    open_: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []  # with open bins, ascending
    done: list[tuple[Pattern, int]] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not room:
            done.append((pattern, n))
        else:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((pattern, n))

    for x in range(cap, 0, -1):
        left = counts[x]
        while left:
            if (i := bisect_left(rooms, x)) == len(rooms):
                each = cap // x
                full, rest = divmod(left, each)
                if full:
                    put(cap - each * x, (x,) * each, full)
                if rest:
                    put(cap - rest * x, (x,) * rest, 1)
                break
            room = rooms[i]
            pattern, n = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[i]
            used = min(n, left)
            if n > used:
                put(room, pattern, n - used)
            put(room - x, (*pattern, x), used)
            left -= used
        counts[x] = 0
    return done + [p for room in rooms for p in open_[room]]


def solve(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Pattern, int]]:
    """Patterns of lengths and how many sequences have each; every item is in one."""
    counts = [0] * (capacity + 1)
    for x, n in histogram.items():
        counts[x] += n
    return reduce_dominated(counts) + best_fit(counts)


def runs(plan: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows (length, first number within the length, sequence of that number, offset), sorted."""
    used: Counter = Counter()
    out, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for x in pattern:
            out.append((x, used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return np.array(sorted(out), dtype=np.int64).reshape(-1, 4)


class Ids:
    """Ids of texts as a ``tokenizers`` file gives them (``add_special_tokens=False``).

    Where ``ranks`` names the same vocabulary for ``tiktoken``, that library, several times as fast, makes the ids: byte
    pair merges within the same pre-tokens. Texts with a special token's string, which only ``tokenizers`` treats as
    one id, go to ``tokenizers``.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str | None = None, pattern: str | None = None):
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self.fast = None
        if ranks_path:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or self.special(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


def _default_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def pieces(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", tokenizer: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    """(key, piece, start, length, ids_crc32): each document's ids and the end id, cut if longer than ``capacity``.

    ``tokenizer``: the arguments of :class:`Ids`. Every piece but the first has ``capacity`` ids; so only one piece of a document is left to pack with others.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import zlib

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        ids_of = Ids(*(tokenizer or _default_tokenizer()))
        end = np.array([END_ID], dtype="<u4")
        for batch in sliced(batches):
            out: list[tuple[int, int, int, int, int]] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = np.concatenate((ids_of.encode(text).astype("<u4", copy=False), end))
                n = len(ids)
                start, length, piece = 0, n if n <= capacity else n % capacity or capacity, 0
                while start < n:
                    out.append((row, piece, start, length, zlib.crc32(ids[start : start + length].data)))
                    start, length, piece = start + length, capacity, piece + 1
            row, piece, start, length, crc = np.array(out, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(key, text_of(text).alias("_text")).mapInArrow(cut, f"{key} {key_type}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", tokenizer: tuple[str, str | None, str | None] | None = None) -> DataFrame:
    """Every document's pieces with sequence_id and offset (its place there, gapless from 0).

    A null text is empty and still has its end id; repeated rows are packed once each; an empty table gives no rows;
    other columns are ignored. Texts are tokenised once: the pieces are staged in the shared folder. One length may
    hold any share of the rows: numbers within a length are dealt over buckets.
    """
    cut = staged(salted(pieces(docs, capacity, key, text, tokenizer), "_salt"), "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    table = runs(solve(histogram, capacity))
    wide = 1 << 50  # above any number of documents of a length

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = table[:, 0] * wide + table[:, 1]
        for b in batches:
            number = b.column("_number").to_numpy()
            at = np.searchsorted(starts, b.column("length").to_numpy() * wide + number, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(table[at, 2] + number - table[at, 1]), pa.array(table[at, 3])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    schema = f"{key} {docs.schema[key].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return numbered(cut, ["length"], [key, "piece", "ids_crc32", "start", "_salt"], "_number").mapInArrow(place, schema)
