"""Toxicity by a weighted lexicon: Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding undoes what hides a word: lower case, compatibility forms (full-width letters and the like), Cyrillic and
Greek look-alikes, invisible characters, digit and sign substitutions inside words, stretched letters. The lexicon is a
seed list plus word stems that labelled training texts show to be toxic. A document's evidence is the sum of the weights
of its words for each word of text; a logistic curve fitted on training texts turns it into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.llm.shared import fresh, kept_columns, sliced, staged, text_of

#: Insults that count from the start; training adds to them and reweights them.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "worthless", "pathetic", "disgusting", "clown")
#: Harmless phrases: words inside one of them are not counted.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "white trash bag", "clown fish", "class clown", "circus clown", "stupid question", "sore loser", "pond scum", "soap scum", "lovable loser")
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e"}
INVISIBLE = "­​‌‍⁠﻿"

_PLAIN = str.maketrans({**LOOKALIKES, **dict.fromkeys(INVISIBLE, "")})
_NONWORD = re.compile(r"[\W_]+")
#: A word with a digit or sign in it, whatever its length; what stands before the first of them is a group.
_HIDDEN = re.compile(r"(?<![\w@$!€])([^\W0-9]*+)[0-9@$!€][\w@$!€]*+")
_LETTER = re.compile(r"[^\W\d_]")
_SIGNS = str.maketrans(SUBSTITUTES)
_STRETCHED = re.compile(r"([a-z])\1{2,}")


def _shown(m: re.Match) -> str:
    """Digits and signs as letters, where a letter follows one of them; else they are numbers or punctuation."""
    word = m[0]
    if len(word) < 3 or not _LETTER.search(word, len(m[1]) + 1):
        return word
    return word.rstrip("!").translate(_SIGNS)


def fold(text: str) -> str:
    """Words of ``text``, folded, with one space before, between and after them. Accents stay: they are letters."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFKC", t).lower().translate(_PLAIN)
    t = _HIDDEN.sub(_shown, t)
    t = _STRETCHED.sub(r"\1", t) if _STRETCHED.search(t) else t
    return f" {_NONWORD.sub(' ', t).strip()} "


@dataclass
class Model:
    """Patterns start with a space (a word's start); those that end with one are whole words, the others stems."""

    weights: dict[str, float]
    exceptions: Sequence[str] = EXCEPTIONS
    curve: tuple[float, ...] = (-4.0, 6.0, 0.5)
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for p, w in self.weights.items():
                self._automaton.add_word(p, (len(p), w))
            for p in self.exceptions:
                self._automaton.add_word(f" {p} ", (len(p) + 2, -1.0))
            self._automaton.make_automaton()
        return self._automaton

    def evidence(self, text: str) -> tuple[float, int, int]:
        """Sum of weights, words that matched, words. A word counts once, by its heaviest pattern."""
        folded = fold(text)
        best: dict[int, float] = {}
        spared: list[tuple[int, int]] = []
        if self.weights:
            for end, (n, w) in self.automaton().iter(folded):
                start = end - n + 1
                if w < 0:
                    spared.append((start, end))
                elif w > best.get(start, 0.0):
                    best[start] = w
        if spared:
            best = outside(best, spared)
        return sum(best.values()), len(best), max(0, folded.count(" ") - 1)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        z = features(evidence) @ np.array(self.curve)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def outside(best: dict[int, float], spans: list[tuple[int, int]]) -> dict[int, float]:
    """The places of ``best`` that lie in none of ``spans`` (end exclusive), by one pass over both in order."""
    spans = sorted(spans)
    left: dict[int, float] = {}
    reach = k = 0
    for at in sorted(best):
        while k < len(spans) and spans[k][0] <= at:
            reach = max(reach, spans[k][1])
            k += 1
        if at >= reach:
            left[at] = best[at]
    return left


def features(evidence: np.ndarray) -> np.ndarray:
    """A constant; evidence per word, bounded; how much evidence there is at all, bounded."""
    weight, _, words = evidence.reshape(-1, 3).T
    return np.column_stack((np.ones(len(weight)), np.minimum(30 * weight / np.maximum(words, 20), 4), np.minimum(np.log1p(weight), 3)))


def patterns_of(folded: str, shortest: int = 3, longest: int = 12) -> set[str]:
    out: set[str] = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(shortest, min(longest, len(w)) + 1))
    return out


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, least: int, ratio: float) -> dict[str, float]:
    """Weights of the patterns in at least ``least`` toxic texts and ``ratio`` times as often there as in clean ones.

    Of nested patterns with about the same toxic texts the longest stays; one that a shorter one covers as well goes.
    """

    def weight(p: str) -> float:
        return math.log((toxic.get(p, 0) + 0.5) / (n_toxic + 1)) - math.log((clean.get(p, 0) + 0.5) / (n_clean + 1))

    good = {p: weight(p) for p, n in toxic.items() if n >= least and weight(p) >= math.log(ratio)}
    deepest: dict[str, int] = {}  # of each pattern, the most toxic texts that any longer pattern has
    for p in good:
        for k in range(4, len(p)):
            deepest[p[:k]] = max(deepest.get(p[:k], 0), toxic[p])
    kept: dict[str, float] = {}
    for p in sorted(good, key=len):
        if deepest.get(p, 0) >= 0.9 * toxic[p] and not p.endswith(" "):
            continue
        if any(p[:k] in kept and kept[p[:k]] >= good[p] - 0.7 for k in range(4, len(p))):
            continue
        kept[p] = good[p]
    return kept


def fit_curve(evidence: np.ndarray, toxic: np.ndarray, counts: np.ndarray | float = 1.0, ridge: float = 0.05, rounds: int = 60) -> tuple[float, ...]:
    """Logistic regression by Newton steps; a pull to 0 keeps it finite where the classes part cleanly. A row weighs ``counts``."""
    x, w = features(evidence), np.zeros(3)
    counts = np.broadcast_to(counts, len(x))
    pull = np.diag([1e-3, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + pull, x.T @ (counts * (toxic - p)) - pull @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def held_out(key: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _share(most: int, own: int, other: int) -> float:
    """Of a class of ``own`` texts beside one of ``other``, the share that a sample of ``most`` takes."""
    return min(1.0, max(most / 2, most - other) / max(1, own))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 8_000, least_share: float = 0.02, ratio: float = 6.0, key: str = "doc_id", text: str = "text", label: str = "toxic", seeds: Sequence[str] = SEEDS) -> Model:
    """Fit on the labelled rows outside the held-out third.

    ``max_train`` bounds the labelled texts used (in expectation; chosen by hash of the text, equal texts once). Either class
    has half of it, and what the other leaves, so that rare toxic texts are learnt from; the curve weighs each class as it is
    in all labelled rows. Only keys and hashes are shuffled to choose them. What comes to the driver: patterns in at least
    ``least_share`` of the toxic texts of that sample, and three numbers a text.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_toxic"))
    known = known.where(~held_out(F.col("_key")))
    found = known.agg(F.count_if(F.col("_toxic") >= 1).alias("toxic"), F.count_if(F.col("_toxic") < 1).alias("clean")).first()
    share = {True: _share(max_train, found["toxic"], found["clean"]), False: _share(max_train, found["clean"], found["toxic"])}
    least_hash = F.when(F.col("_toxic") >= 1, int(share[True] * (1 << 32))).otherwise(int(share[False] * (1 << 32)))
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), text_of(text).alias("_text"))
    hashed = own.select("_key", F.xxhash64("_text").alias("_hash")).where(F.pmod("_hash", F.lit(1 << 32)) < int(max(share.values()) * (1 << 32)))
    chosen = hashed.join(known, "_key").groupBy("_hash").agg(F.max("_toxic").cast("int").alias("_toxic"), F.min("_key").alias("_key"))
    chosen = staged(chosen.where(F.pmod("_hash", F.lit(1 << 32)) < least_hash), "toxicity-chosen")
    if chosen.count() <= 2 * max_train:
        chosen = F.broadcast(chosen)
    sample = own.withColumn("_hash", F.xxhash64("_text")).join(chosen, ["_key", "_hash"])
    sample = staged(sample.groupBy("_text").agg(F.max("_toxic").alias("_toxic")), "toxicity-sample")
    weights = {f" {w} ": 3.0 for w in seeds}

    def counted(among: frozenset[str] | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c: Counter = Counter()
            for b in sliced(batches):
                for t in b.column(0).to_pylist():
                    found = patterns_of(fold(t))
                    c.update(found if among is None else found & among)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["pattern", "n"])

        return count

    sizes = {r["_toxic"]: r["n"] for r in sample.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sum(v for k, v in sizes.items() if k >= 1), sum(v for k, v in sizes.items() if k < 1)
    if not n_toxic or not n_clean:
        return Model(weights)
    least = max(3, math.ceil(least_share * n_toxic))
    schema = "pattern string, n long"
    total = F.sum("n").alias("n")
    toxic = {r["pattern"]: r["n"] for r in sample.where("_toxic >= 1").select("_text").mapInArrow(counted(None), schema).groupBy("pattern").agg(total).where(F.col("n") >= least).collect()}
    clean = {r["pattern"]: r["n"] for r in sample.where("_toxic < 1").select("_text").mapInArrow(counted(frozenset(toxic)), schema).groupBy("pattern").agg(total).collect()}
    weights |= choose(toxic, clean, n_toxic, n_clean, least, ratio)
    model = Model(weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            e = np.array([model.evidence(t) for t in b.column(0).to_pylist()], dtype=float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(e[:, 2]), b.column(1)], names=["w", "m", "n", "y"])

    rows = np.array([tuple(r) for r in sample.select("_text", "_toxic").mapInArrow(measure, "w double, m double, n double, y int").collect()], dtype=float)
    bad = rows[:, 3] >= 1
    counts = np.where(bad, 1 / share[True], 1 / share[False])
    model.curve = fit_curve(rows[:, :3], bad.astype(float), counts / counts.mean())
    return model


def score_toxicity(docs: DataFrame, model: Model, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (1 from ``threshold``), hits (words that matched) and toxic_weight.

    One pass without a shuffle. A null text is empty; an empty text has the score of no evidence; repeated rows get
    the same score. Columns of these names are replaced.
    """
    kept = kept_columns(docs, "score", "predicted", "hits", "toxic_weight")
    (own,) = fresh(docs, "_judged")
    kind = "struct<score: double, predicted: int, hits: long, toxic_weight: double>"

    from pyspark.sql.functions import arrow_udf

    @arrow_udf(kind)
    def judge(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            e = np.array([model.evidence(x.as_py()) for x in t], dtype=float).reshape(-1, 3)
            s = model.score(e)
            yield pa.StructArray.from_arrays([pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(e[:, 1].astype(np.int64)), pa.array(e[:, 0])], names=["score", "predicted", "hits", "toxic_weight"])

    return docs.select(*kept, judge(text_of(text)).alias(own)).select(*kept, f"{own}.*")
