"""Secret scans: fixed formats, and a randomness test battery over long tokens.

A token's encoding is inferred from its characters. Three tests ask whether it could be random in that alphabet:
chi-squared uniformity, runs about the middle of the alphabet, lag-one serial correlation. A token that they reject is
text. For the others the chi-squared value gives the probability that text of that length comes out as even; since the
value of text grows with length, short tokens cannot be called random. Benjamini-Hochberg keeps the share of false calls
bounded within each encoding and length class, over all tokens of the table.

Only built-in functions are used; texts are read once and never shuffled.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.arrays import match_spans
from quarrylight.llm.shared import fresh, kept_columns, let, staged, text_of

# The formats of the contract, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: Tokens that the tests look at; a '=' before one stands between a name and its value.
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}(?![A-Za-z0-9+/_=-])"


@dataclass(frozen=True)
class Encoding:
    """``excess``: how far text is from uniform in this alphabet, ``len(alphabet) * sum(share ** 2) - 1``."""

    name: str
    pattern: str
    alphabet: str
    excess: float


_D, _L, _U = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Tried in this order; tokens of digits alone are numbers, not secrets.
ENCODINGS = (
    Encoding("hex", r"^(?=.*[0-9])(?=.*[a-fA-F])(?:[0-9a-f]+|[0-9A-F]+)$", _D + "abcdef", 1.0),
    Encoding("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+={0,2}$", _U + "234567", 1.2),
    Encoding("base36", r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-z]+|[0-9A-Z]+)$", _D + _L, 1.4),
    Encoding("letters", r"^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$", _L, 0.7),
    Encoding("base64", r"^(?=.*[A-Za-z])[A-Za-z0-9+/_-]+={0,2}$", _U + _L + _D + "-_", 2.6),
)
#: Lower ends of the length classes.
LENGTHS = (20, 32, 48, 80)

_TOKENS = "array<struct<start:bigint,end:bigint,stratum:int,p:double>>"


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the normal law (Abramowitz and Stegun 26.2.17; error below 1e-7)."""

    def of(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * F.abs(x))
        tail = F.exp(-x * x / 2) * 0.3989422804014327 * (t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))))
        return F.when(x >= 0, tail).otherwise(1 - tail)

    return let(F.greatest(F.least(z, F.lit(37.0)), F.lit(-37.0)), of)


def _plain(token: Column, e: Encoding) -> Column:
    """The token in its alphabet's own characters, without padding."""
    bare = F.rtrim(token, F.lit("=")) if e.name in ("base32", "base64") else token
    if e.name == "base64":
        return F.translate(bare, "+/", "-_")
    return bare if e.name == "base32" else F.lower(bare)


def battery(plain: Column, e: Encoding) -> Column:
    """struct<n, chi, z_chi, z_runs, z_serial> for a non-empty ``plain``."""
    k = len(e.alphabet)
    n = F.length(plain).cast("double")
    symbols = F.array(*[F.lit(c) for c in e.alphabet])
    squares = F.aggregate(F.transform(symbols, lambda c: F.pow(n - F.length(F.replace(plain, c, F.lit(""))), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    chi = k / n * squares - n
    v = float(k - 1)
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / v, F.lit(1 / 3)) - (1 - 2 / (9 * v))) / (2 / (9 * v)) ** 0.5
    halves = F.translate(plain, e.alphabet, "0" * (k // 2) + "1" * (k - k // 2))

    def runs(b: Column) -> Column:
        ones = F.length(F.replace(b, F.lit("0"), F.lit(""))).cast("double")
        turns = (2 * n - F.length(F.replace(b, F.lit("01"), F.lit(""))) - F.length(F.replace(b, F.lit("10"), F.lit("")))) / 2
        mean = 2 * ones * (n - ones) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        return F.when(var > 0, (turns + 1 - mean) / F.sqrt(var)).otherwise(F.lit(37.0))

    def serial(x: Column) -> Column:
        s = F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
        s2 = F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y)
        lag = F.zip_with(x, F.concat(F.slice(x, F.lit(2), F.size(x)), F.slice(x, F.lit(1), F.lit(1))), lambda p, q: p * q)
        s11 = F.aggregate(lag, F.lit(0.0), lambda a, y: a + y)
        low = n * s2 - s * s
        r = (n * s11 - s * s) / low
        return F.when(low > 0, (r + 1 / (n - 1)) / (n / ((n - 1) * F.sqrt(n - 2)))).otherwise(F.lit(37.0))

    places = F.transform(F.split(plain, "", -1), lambda c: F.instr(F.lit(e.alphabet), c).cast("double"))
    places = F.filter(places, lambda x: x > 0)
    return F.struct(n.alias("n"), chi.alias("chi"), z_chi.alias("z_chi"), let(halves, runs).alias("z_runs"), let(places, serial).alias("z_serial"))


def _tested(span: Column, reject: float) -> Column:
    """struct<start, end, stratum, p> of a token; null if it is no candidate or the tests call it text."""
    out = None
    for i, e in enumerate(ENCODINGS):

        def judged(t: Column, e: Encoding = e, i: int = i) -> Column:  # noqa: B023
            spread = F.sqrt(2 * (len(e.alphabet) - 1 + 2 * e.excess * t["n"]))
            p = normal_tail((len(e.alphabet) - 1 + e.excess * t["n"] - t["chi"]) / spread)
            worst = F.least(normal_tail(t["z_chi"]), 2 * normal_tail(F.abs(t["z_runs"])), 2 * normal_tail(F.abs(t["z_serial"])))
            size = F.lit(0)
            for least in LENGTHS[1:]:
                size = size + (t["n"] >= least).cast("int")
            row = F.struct(span["start"].alias("start"), span["end"].alias("end"), (size + i * len(LENGTHS)).alias("stratum"), p.alias("p"))
            return F.when((worst * 3 >= reject) & (t["n"] >= LENGTHS[0]), row)

        value = let(battery(_plain(span["group"], e), e), judged)
        out = F.when(span["group"].rlike(e.pattern), value) if out is None else out.when(span["group"].rlike(e.pattern), value)
    return out


def scan(docs: DataFrame, text: str = "text", reject: float = 1e-3, false_share: float = 0.01) -> DataFrame:
    """``docs`` without ``text``, with ``spans``: array<struct<start, end, kind>> sorted by start, then kind.

    Places are code points, ends exclusive. ``kind`` indexes :data:`KINDS`; spans of the tests ('random') are left out
    where they touch a span of a fixed format. ``reject`` is the level at which the tests call a token text;
    ``false_share`` bounds the expected share of text among the tokens called random. A null text is empty and has no
    spans; repeated rows get equal spans; an empty table gives no rows. A column named spans is replaced.
    """
    t = text_of(text)
    none = F.array().cast("array<struct<start:bigint,end:bigint,group:string>>")
    # what no match can do without is looked for first: most texts go no further
    likely = t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    assign = F.when(likely, F.filter(match_spans(t, ASSIGN, 2), lambda s: F.length(s["group"]) >= 12)).otherwise(none)
    access = F.when(t.contains("AKIA"), match_spans(t, ACCESS)).otherwise(none)
    fixed = [assign, access, match_spans(t, HEX)]
    kinds = "array<struct<start:bigint,kind:int,end:bigint>>"
    marked = F.array_sort(F.concat(*[_mark(s, k) for k, s in enumerate(fixed)]))
    kept = kept_columns(docs, text, "spans")
    fixed_, tokens_ = fresh(docs, "_fixed", "_tokens")
    tokens = F.filter(F.transform(match_spans(t, TOKEN), lambda s: _tested(s, reject)), lambda s: s.isNotNull()).cast(_TOKENS)
    found = staged(docs.select(*kept, marked.cast(kinds).alias(fixed_), tokens.alias(tokens_)), "secret-spans")
    limits = discovery_limits(found.select(F.explode(tokens_).alias("t")).select("t.stratum", "t.p"), false_share)
    random = F.lit(None).cast("array<struct<start:bigint,kind:int,end:bigint>>")
    if limits:
        by = F.create_map(*[F.lit(x) for pair in sorted(limits.items()) for x in pair])
        called = F.filter(tokens_, lambda s: F.coalesce(s["p"] <= F.element_at(by, s["stratum"]), F.lit(False)))
        called = F.filter(called, lambda s: ~F.exists(fixed_, lambda f: (f["start"] < s["end"]) & (f["end"] > s["start"])))
        random = F.transform(called, lambda s: F.struct(s["start"].alias("start"), F.lit(3).alias("kind"), s["end"].alias("end")))
    both = F.array_sort(F.concat(fixed_, F.coalesce(random, F.array().cast(kinds))))
    return found.select(*kept, F.transform(both, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def _mark(spans: Column, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def discovery_limits(tokens: DataFrame, false_share: float) -> dict[int, float]:
    """Benjamini-Hochberg limits of ``p`` by stratum (at most 20), from counts on a grid of ``p``.

    The grid's steps are a factor of exp(1/8); a step's upper end stands for it, so a limit is never too large.
    """
    step = F.least(F.floor(-8 * F.ln(F.greatest("p", F.lit(1e-300)))), F.lit(5600))
    counts = tokens.select("stratum", step.alias("step")).groupBy("stratum", "step").agg(F.count("*").alias("n"))
    smaller = Window.partitionBy("stratum").orderBy(F.desc("step"))
    upto = counts.select("stratum", "step", F.sum("n").over(smaller).alias("upto"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    high = F.exp(-F.col("step") / 8)
    limits = upto.where(high * F.col("all") / F.col("upto") <= false_share).groupBy("stratum").agg(F.max(high).alias("limit"))
    return {r["stratum"]: r["limit"] for r in limits.collect()}


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with ``mark`` in the place of each span; overlapping spans are one."""
    merged = F.aggregate(
        spans,
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
            F.struct(
                s["end"].alias("at"),
                F.concat(a["out"], F.when(s["start"] >= a["at"], F.concat(F.substring(text, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))).alias("out"),
            )
        ),
        lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    return F.when(F.size(spans) > 0, merged).otherwise(text)
