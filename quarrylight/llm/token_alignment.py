"""Alignment of two tokenizers' tokens of the same text, by skipping runs on the current diagonal.

The tokens of both sides end at byte offsets, two ascending arrays. Where they stand at indices ``i`` and ``j``, the shift
``j - i`` is a diagonal: probes of doubling length compare the arrays along it and jump one-to-one stretches; at the first
difference the irregular group is resolved token by token, which changes the shift. Many stretches of text (lanes) are walked
at once in numpy, each on its own diagonal. Beside the groups the walk gives the links: every pair of tokens that overlap.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.shared import sliced, staged

#: Tokens of the first side in a lane, about; lanes begin where both sides are known to end.
LANE = 128
#: Words whose tokens a worker remembers.
REMEMBERED = 300_000


class Tokenizers(NamedTuple):
    """Paths of a byte-level BPE file for ``tokenizers`` (A) and of a model for ``sentencepiece`` (B)."""

    a: str
    b: str


def _default_tokenizers() -> Tokenizers:
    import public_tokenizers

    return Tokenizers(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


# ---- alignment --------------------------------------------------------------------------------------------------


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(int(counts.sum()))


def align(ends_a: np.ndarray, ends_b: np.ndarray, lanes_a: np.ndarray, lanes_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of all tokens whose byte ranges overlap, in order.

    The ends ascend over all texts; lane ``k`` is the tokens from ``lanes_a[k]`` and ``lanes_b[k]`` up to the next lane's (the
    last lane's entries are the lengths of the arrays), and both sides must end together there. A link closes a group
    where its two ends are equal.
    """
    last = lanes_a[1:]
    i, j = lanes_a[:-1].copy(), lanes_b[:-1].copy()
    probe = np.ones(len(i), dtype=np.int64)
    fresh = np.ones(len(i), dtype=bool)  # the walk stands at the beginning of a group
    link = np.full(len(ends_a) + len(ends_b) + 1, -1, dtype=np.int64)  # by i + j, which grows along a walk
    live = np.flatnonzero(i < last)
    while len(live):
        li, lj, step = i[live], j[live], probe[live]
        long = step > 1
        if long.any():  # probes along the diagonal
            at = np.flatnonzero(long)
            n = np.minimum(np.minimum(step[at], last[live[at]] - li[at]), lanes_b[live[at] + 1] - lj[at])
            x, y = _spread(li[at], n), _spread(lj[at], n)
            differs = np.flatnonzero(ends_a[x] != ends_b[y])
            begins = np.cumsum(n) - n
            first = np.append(differs, len(x))[np.searchsorted(differs, begins)]
            equal = np.minimum(first - begins, n)
            whole = equal == n
            keep = np.arange(len(x)) - np.repeat(begins, n) < np.repeat(equal, n)
            link[(x + y)[keep]] = x[keep]
            li[at] += equal
            lj[at] += equal
            step[at] = np.where(whole, step[at] * 2, 1)
        at = np.flatnonzero(~long)  # one link; the token that ends first is passed, or both
        if len(at):
            x, y = li[at], lj[at]
            link[x + y] = x
            ea, eb = ends_a[x], ends_b[y]
            li[at] = x + (ea <= eb)
            lj[at] = y + (eb <= ea)
            step[at] = np.where((ea == eb) & fresh[live[at]], 2, 1)  # a one-to-one group: probe for more
            fresh[live[at]] = ea == eb
        i[live], j[live], probe[live] = li, lj, step
        live = live[li < last[live]]
    key = np.flatnonzero(link >= 0)
    a = link[key]
    return a, key - a


# ---- tokens -----------------------------------------------------------------------------------------------------


class _Words(dict):
    """Numbers of words; new ones wait for their tokens."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class _Side:
    """Tokens of the remembered words of one tokenizer, one after the other."""

    def __init__(self):
        self.flat, self.starts, self.n = (np.zeros(0, dtype=np.int32) for _ in range(3))

    def add(self, ids: np.ndarray, n: np.ndarray) -> None:
        self.flat = np.concatenate((self.flat, ids.astype(np.int32)))
        self.n = np.concatenate((self.n, n.astype(np.int32)))
        self.starts = np.cumsum(self.n) - self.n

    def only(self, words: np.ndarray) -> None:
        self.flat, self.n = self.of(words), self.n[words]
        self.starts = np.cumsum(self.n) - self.n

    def of(self, words: np.ndarray) -> np.ndarray:
        return self.flat[_spread(self.starts[words], self.n[words])]


class Encoder:
    """Ids of both tokenizers.

    A word here is what follows a space that stands behind a character other than white space, up to the next such space. No
    token of A goes over such a space, since its pre-tokens do not; no piece of B does if no piece has its space sign behind
    another character, which is checked. So words are encoded once each and remembered, and texts are put together of them;
    both sides end together before each word.
    """

    def __init__(self, files: Tokenizers):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(files.a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=files.b)
        self.bytes_a = self._byte_level(self.a)
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        if any(" " in x.lstrip(b" ").decode("utf-8", "replace") for x in self.bytes_b):
            raise ValueError("a piece goes over the beginning of a word")
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << 16:
            raise ValueError("ids of pairs have 16 bits a side")
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.inner = re.compile(r"(?<=\S) ")
        self.odd = re.compile(r"\s |^ ").search
        self.forget()

    def forget(self) -> None:
        self.words, self.side_a, self.side_b, self.fine, self.used = _Words(), _Side(), _Side(), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64)

    def trim(self) -> None:
        """Forget words that were met once, and more where that is not enough."""
        if len(self.words) <= REMEMBERED:
            return
        least = 2
        while (keep := np.flatnonzero(self.used >= least)).size > REMEMBERED // 2:
            least *= 2
        known = list(self.words)
        self.words = _Words()
        for w in keep.tolist():
            self.words[known[w]] = len(self.words)
        self.side_a.only(keep)
        self.side_b.only(keep)
        self.fine, self.used = self.fine[keep], self.used[keep] // 2

    @staticmethod
    def _byte_level(tokenizer) -> list[bytes]:
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        of = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        out = [b""] * tokenizer.get_vocab_size()
        for token, i in tokenizer.get_vocab().items():
            out[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode()
        return out

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def split(self, text: str) -> list[str]:
        """The words of space + text, each without its first space."""
        if not self.odd(text):
            return text.split(" ")
        words = self.inner.split(" " + text)
        words[0] = words[0][1:]
        return words

    def learn(self) -> None:
        """Tokens of the new words, and whether their bytes are the words'."""
        new, self.words.new = self.words.new, []
        alone = self.b.piece_to_id("▁")
        for at in range(0, len(new), 20_000):
            some = new[at : at + 20_000]
            spelt = [(" " + w).encode() for w in some]
            a = [e.ids for e in self.a.encode_batch([" " + w for w in some], add_special_tokens=False)]
            b = self.b.encode(some, num_threads=1)
            fine = np.ones(len(some), dtype=bool)
            for ids, side, lengths, table in ((a, self.side_a, self.length_a, self.bytes_a), (b, self.side_b, self.length_b, self.bytes_b)):
                if side is self.side_b:
                    ids = [x if w else [alone] for w, x in zip(some, ids, strict=True)]
                n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(n.sum()))
                size = np.fromiter(map(len, spelt), dtype=np.int64, count=len(spelt))
                ends = np.append(0, np.cumsum(lengths[flat]))[np.cumsum(n)]
                if not np.array_equal(ends, np.cumsum(size)) or b"".join(map(table.__getitem__, flat.tolist())) != b"".join(spelt):
                    fine &= [b"".join(map(table.__getitem__, x)) == w for x, w in zip(ids, spelt, strict=True)]
                side.add(flat, n)
            self.fine = np.concatenate((self.fine, fine))
        self.used = np.concatenate((self.used, np.zeros(len(new), dtype=np.int64)))


_encoders: dict[Tokenizers, Encoder] = {}


def _encoder(files: Tokenizers) -> Encoder:
    """The encoder of this worker, which goes on remembering from task to task."""
    if files not in _encoders:
        _encoders[files] = Encoder(files)
    return _encoders[files]


class Block(NamedTuple):
    """The tokens of some texts one after the other, and their links; ``at_a``, ``at_b`` and ``at_link`` say where each text's begin and, last, the lengths.

    ``moves`` has a link's end: 1 where only its A token ends there, 2 where only its B token does, 3 where a group ends.
    """

    ids_a: np.ndarray
    ids_b: np.ndarray
    moves: np.ndarray
    at_a: np.ndarray
    at_b: np.ndarray
    at_link: np.ndarray

    def pairs(self) -> np.ndarray:
        """Of each link, id of A * 65536 + id of B. Each text ends with a group, so tokens are passed as moves say over all texts."""
        a, b = self.moves & 1, self.moves >> 1
        return self.ids_a[np.cumsum(a, dtype=np.int64) - a].astype(np.int64) << 16 | self.ids_b[np.cumsum(b, dtype=np.int64) - b]


def block(encoder: Encoder, texts: list[str | None]) -> Block:
    """Encode and align; null and empty texts, and texts that a tokenizer changes, have no tokens."""
    encoder.trim()
    number = encoder.words.__getitem__
    words = [encoder.split(t) if t else [] for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    codes = np.fromiter(map(number, chain.from_iterable(words)), dtype=np.int64, count=int(counts.sum()))
    del words
    encoder.learn()
    encoder.used += np.bincount(codes, minlength=len(encoder.used))
    text = np.repeat(np.arange(len(texts)), counts)
    odd = np.bincount(text[~encoder.fine[codes]], minlength=len(texts)) > 0
    codes, counts = codes[~odd[text]], np.where(odd, 0, counts)
    n_a, n_b = encoder.side_a.n[codes], encoder.side_b.n[codes]
    ids_a, ids_b = encoder.side_a.of(codes), encoder.side_b.of(codes)
    ends_a, ends_b = np.cumsum(encoder.length_a[ids_a]), np.cumsum(encoder.length_b[ids_b])
    before_a, before_b = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))  # of each word
    first = np.append(0, np.cumsum(counts))
    # lanes: texts, and in long ones the first word after every LANE tokens
    lane = np.unique(np.concatenate((first, np.searchsorted(before_a, np.arange(0, before_a[-1], LANE)))))
    a, b = align(ends_a, ends_b, before_a[lane], before_b[lane])
    moves = (ends_a[a] <= ends_b[b]).astype(np.uint8) | ((ends_b[b] <= ends_a[a]).astype(np.uint8) << 1)
    at_a = before_a[first]
    return Block(ids_a, ids_b, moves, at_a, before_b[first], np.searchsorted(a, at_a))


def _by_size(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of rows of about ``most`` in all."""
    at, total = 0, np.append(0, np.cumsum(sizes))
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, side="right")) - 1)
        yield slice(at, to)
        at = to


def _written(ids_a: np.ndarray, ids_b: np.ndarray, moves: np.ndarray, table_a: np.ndarray, table_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3`` of one text. The tables have what each id is written as, within a group and as its last."""
    closes = moves == 3
    end_a, end_b = (np.cumsum(m, dtype=np.int64)[closes] - 1 for m in (moves & 1, moves >> 1))  # the last token of each group
    last_a, last_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
    last_a[end_a], last_b[end_b] = 1, 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    out[np.arange(len(ids_a)) + np.append(0, end_b + 1)[group_a]] = table_a[ids_a.astype(np.int64) * 2 + last_a]  # behind the B tokens of the groups before
    out[np.arange(len(ids_b)) + (end_a + 1)[group_b]] = table_b[ids_b.astype(np.int64) * 2 + last_b]  # behind the A tokens of its own group
    return b"".join(out.tolist())[:-1]


def _tables(n: int, sign: str) -> np.ndarray:
    out = np.empty(2 * n, dtype=object)
    out[:] = [f"{i}{s}".encode() for i in range(n) for s in (",", sign)]
    return out


# ---- the operator -------------------------------------------------------------------------------------------------


def aligned(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: Tokenizers | None = None) -> DataFrame:
    """(key, ids_a, ids_b, moves): each row's ids, two bytes each, and the moves of its links (:class:`Block`), a byte each."""
    files = tokenizers or _default_tokenizers()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(files)
        for batch in sliced(batches):
            sizes = np.nan_to_num(batch.column(2).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
            for part in _by_size(sizes, 1 << 20):
                rows = batch.slice(part.start, part.stop - part.start)
                x = block(encoder, rows.column(1).to_pylist())
                columns = [pa.array([raw[i:j] for i, j in zip((at * each)[:-1].tolist(), (at * each)[1:].tolist(), strict=True)], pa.binary()) for raw, at, each in ((x.ids_a.astype("<u2").tobytes(), x.at_a, 2), (x.ids_b.astype("<u2").tobytes(), x.at_b, 2), (x.moves.tobytes(), x.at_link, 1))]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=[key, "ids_a", "ids_b", "moves"])

    return docs.select(F.col(key), F.col(text), F.length(text).alias("size")).mapInArrow(encode, f"{key} {docs.schema[key].dataType.simpleString()}, ids_a binary, ids_b binary, moves binary")


def _blocks(batch: pa.RecordBatch, first: int) -> Iterator[tuple[slice, Block]]:
    """The rows of a batch of :func:`aligned` in parts; ``first``: the column of ``ids_a``."""
    columns = [batch.column(first + i).to_pylist() for i in range(3)]
    sizes = [np.fromiter(map(len, c), dtype=np.int64, count=len(c)) for c in columns]
    for part in _by_size(sizes[2], 1 << 20):
        (ids_a, ids_b, moves), ats = zip(*((np.frombuffer(b"".join(c[part]), dtype=kind), np.append(0, np.cumsum(n[part])) // np.dtype(kind).itemsize) for c, n, kind in zip(columns, sizes, ("<u2", "<u2", "u1"), strict=True)), strict=True)
        yield part, Block(ids_a, ids_b, moves, *ats)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold a pair of ids (a * 65536 + b) linked. Each task adds up its own rows first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held = [], 0

        def out(both: pd.Series) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(both.index.to_numpy(np.int64)), pa.array(both.to_numpy(np.int64))], names=["pair", "n"])

        for batch in sliced(batches):
            for _, x in _blocks(batch, 0):
                row = np.repeat(np.arange(len(x.at_link) - 1), np.diff(x.at_link))
                once = pd.unique(row.astype(np.uint64) << np.uint64(32) | x.pairs().astype(np.uint64)) & np.uint64(0xFFFFFFFF)
                sums.append(pd.Series(once).value_counts(sort=False))
                held += len(sums[-1])
                if held > 1_000_000:
                    sums = [pd.concat(sums).groupby(level=0, sort=False).sum()]
                    held = len(sums[0])
                    if held > 500_000:
                        yield out(sums[0])
                        sums, held = [], 0
        if sums:
            yield out(pd.concat(sums).groupby(level=0, sort=False).sum())

    return aligned.select("ids_a", "ids_b", "moves").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _frequent(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(pairs ascending, counts, least): the pairs with at least ``least`` rows, ``most`` of them or fewer."""
    # sixteenths of powers of two: some 600 rows, whatever the counts
    grade = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["g"], r["k"], r["lo"]) for r in counts.groupBy(grade.alias("g")).agg(F.count("*").alias("k"), F.min("n").alias("lo")).collect()), reverse=True)
    held, least = 0, None
    for _, k, lo in sizes:
        if held + k > most:
            break
        held, least = held + k, lo
    if least is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 1 << 62
    rows = counts.where(F.col("n") >= least).toPandas().sort_values("pair")  # at most `most`
    return rows["pair"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), int(least)


_COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def align_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizers: Tokenizers | None = None, most_kept: int = 500_000) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row.

    Links are all pairs of tokens whose bytes overlap; the count of a pair of ids is in how many rows they are linked;
    ``n_best`` are the links with the highest count of their A id, ties included; ``count_sum`` adds up the counts of all links;
    ``groups_sha256`` is of the groups as ``a1,a2|b1;a3|b2,b3``. Rows whose text is null, empty or changed by a tokenizer have no
    tokens: zeros and an empty ``groups_sha256``. Repeated rows count as a row each; a null key is kept; an empty table
    gives no rows; other columns are ignored.

    Texts are encoded and aligned once, and ids and links staged. The most frequent pairs (``most_kept`` at most, so their size
    is bounded) go to the tasks; links of other pairs, each of them rare, are joined with their counts by shuffle.
    """
    files = tokenizers or _default_tokenizers()
    made = staged(aligned(docs, key, text, files), "aligned")
    counts = staged(pair_counts(made), "pair-counts")
    kept, kept_n, least = _frequent(counts, most_kept)
    best = np.zeros(1 << 16, dtype=np.int64)
    for r in counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("n")).collect():  # a row for each id of A
        best[r["a"]] = r["n"]
    schema = f"{key} {docs.schema[key].dataType.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, rare array<struct<pair: long, times: long>>"
    rare_type = pa.list_(pa.struct([("pair", pa.int64()), ("times", pa.int64())]))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_a, table_b = _tables(1 << 16, "|"), _tables(1 << 16, ";")
        for batch in sliced(batches):
            for part, x in _blocks(batch, 1):
                n = part.stop - part.start
                row = np.repeat(np.arange(n), np.diff(x.at_link))
                which, pairs = pd.factorize(x.pairs())
                place = np.minimum(np.searchsorted(kept, pairs), max(0, len(kept) - 1))
                known = kept[place] == pairs if len(kept) else np.zeros(len(pairs), dtype=bool)
                count = np.where(known, kept_n[place], 0) if len(kept) else np.zeros(len(pairs), dtype=np.int64)
                is_best = known & (count == best[pairs >> 16])
                sums = [np.diff(x.at_a), np.diff(x.at_b), _sums(x.moves == 3, x.at_link), np.diff(x.at_link), _sums(is_best[which], x.at_link), _sums(count[which], x.at_link)]
                rare: list[list] = [[] for _ in range(n)]
                if not known.all():
                    lost = ~known[which]
                    some = pd.DataFrame({"row": row[lost], "pair": pairs[which[lost]]}).value_counts(sort=False)
                    for (r, p), times in some.items():
                        rare[r].append({"pair": p, "times": times})
                hashes = []
                for k in range(n):
                    at, to = x.at_link[k], x.at_link[k + 1]
                    hashes.append(hashlib.sha256(_written(x.ids_a[x.at_a[k] : x.at_a[k + 1]], x.ids_b[x.at_b[k] : x.at_b[k + 1]], x.moves[at:to], table_a, table_b)).hexdigest() if to > at else "")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, n), *(pa.array(v.astype(np.int64)) for v in sums), pa.array(hashes, pa.string()), pa.array(rare, rare_type)], names=[key, *_COLUMNS, "rare"])

    done = made.mapInArrow(digest, schema)
    if least <= 1:  # every pair went to the tasks
        return done.select(key, *_COLUMNS)
    done = staged(done.withColumn("_row", F.monotonically_increasing_id()), "digests")
    top = counts.groupBy(F.shiftright("pair", 16).alias("_a")).agg(F.max("n").alias("_top"))
    links = done.select("_row", F.explode("rare").alias("r")).select("_row", "r.pair", "r.times").join(counts.where(F.col("n") < least), "pair")
    links = links.withColumn("_a", F.shiftright("pair", 16)).join(F.broadcast(top), "_a")  # a row for each id of A
    more = links.groupBy("_row").agg(F.sum(F.col("times") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("n") == F.col("_top"), F.col("times")).otherwise(0)).alias("_best"))
    added = {"n_best": "_best", "count_sum": "_sum"}
    return done.join(more, "_row", "left").select(key, *[(F.col(c) + F.coalesce(F.col(added[c]), F.lit(0))).alias(c) if c in added else F.col(c) for c in _COLUMNS])


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between the places ``at``."""
    return np.diff(np.append(0, np.cumsum(values))[at])
