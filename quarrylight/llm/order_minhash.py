"""Document fingerprints by Order MinHash, sensitive to edit distance.

A text's k-mers (of words; longer words are cut, in scripts without spaces into characters) get occurrence numbers, so that repeats count. Their hashes are dealt into
bins; each bin keeps its smallest, which stands in text order with that of its neighbour bin, and the pair's hash, in
that order, is one element of the fingerprint. Two texts share an element if they share both k-mers and their order, so
the share of equal elements falls with edits and with moved passages, where plain MinHash would not see the latter.
One hash for all bins stands in for one permutation for each element.

Only built-in functions are used, sorted arrays of longs throughout: work grows with a text as n log n.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.llm.shared import let, salted, staged, text_of

ELEMENTS = 64
#: Scripts without spaces: in long words their characters are units, so that an edit does not shift the pieces behind it.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
_PLACE = 26  # bits of a k-mer's place; 37 are its hash
_LOWEST = -(2**63)


def _places(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def with_elements(df: DataFrame, text: str, out: str, k: int = 3, elements: int = ELEMENTS, longest: int = 16) -> DataFrame:
    """``df`` with ``out``: array<long>, for each element that has a k-mer ``index << 32 | hash``.

    ``text`` must not be null. A text under ``k`` words has one k-mer of all its words, an empty one none. The steps are
    columns of their own, so that each is made once and sorts run on plain longs.
    """
    per = 2
    shift = 63 - (elements * per - 1).bit_length()
    if elements * per != 1 << (63 - shift):
        raise ValueError("the number of elements must be a power of two")
    kept = [F.col(c) for c in df.columns if c != out]
    other = r"[^\x20\x09-\x0D]"
    words = F.regexp_extract_all(text, F.lit(rf"{_UNSPACED}(?={other}{{{longest}}})|{other}{{1,{longest}}}"), F.lit(0))
    at = df.select(*kept, words.alias("_w"))
    # hash and place of each k-mer, sorted: equal k-mers stand together in text order
    count = F.greatest(F.size("_w") - (k - 1), F.least(F.size("_w"), F.lit(1)))
    word = lambda i: F.coalesce(F.get("_w", i), F.lit(""))
    packed = F.transform(_places(count), lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[word(i + j) for j in range(k)]), 64 - 37), _PLACE) + i)
    at = at.select(*kept, F.sort_array(packed).alias("_s"))
    kmer = lambda x: F.shiftright(x, _PLACE)
    first = F.filter(_places(F.size("_s")), lambda i: (i == 0) | (kmer(F.get("_s", i)) != kmer(F.get("_s", i - 1))))
    at = at.select(*kept, "_s", first.alias("_f"))
    place = F.lit((1 << _PLACE) - 1).cast("long")
    rehash = lambda x, n: F.shiftleft(F.shiftrightunsigned(F.xxhash64(kmer(x), n.cast("long")), 64 - 37), _PLACE) + x.bitwiseAND(place)
    once = F.transform("_f", lambda i: rehash(F.get("_s", i), F.lit(0)))
    # of k-mers that repeat: the second, third ... in text order
    runs = F.filter(F.transform("_f", lambda i, j: F.struct((i + 1).alias("at"), (F.coalesce(F.get("_f", j + 1), F.size("_s")) - i - 1).alias("n"))), lambda r: r["n"] > 0)
    again = F.flatten(F.transform(runs, lambda r: F.transform(F.slice("_s", r["at"] + 1, r["n"]), lambda x, o: rehash(x, o + 1))))
    at = at.select(*kept, F.sort_array(F.when(F.size("_f") == F.size("_s"), once).otherwise(F.concat(once, again))).alias("_t"))
    bin_ = lambda x: F.shiftright(x, shift)
    low = F.transform(F.filter(_places(F.size("_t")), lambda i: (i == 0) | (bin_(F.get("_t", i)) != bin_(F.get("_t", i - 1)))), lambda i: F.get("_t", i))
    at = at.select(*kept, low.alias("_m"))
    pair = lambda x: F.shiftright(x, shift + 1)

    def element(i: Column) -> Column:
        x, y = F.get("_m", i), F.get("_m", i + 1)
        both = F.coalesce(pair(y) == pair(x), F.lit(False))
        forward = x.bitwiseAND(place) < y.bitwiseAND(place)
        h = F.when(~both, F.xxhash64(kmer(x))).when(forward, F.xxhash64(kmer(x), kmer(y))).otherwise(F.xxhash64(kmer(y), kmer(x)))
        return F.shiftleft(pair(x), 32) + F.shiftrightunsigned(h, 32)

    heads = F.filter(_places(F.size("_m")), lambda i: (i == 0) | (pair(F.get("_m", i)) != pair(F.get("_m", i - 1))))
    return at.select(*kept, F.transform(heads, element).alias(out))


def written(elements: Column) -> Column:
    """A fingerprint as a string: for each element two hexadecimal digits of its index and eight of its hash."""
    return F.array_join(F.transform(elements, lambda e: F.lower(F.lpad(F.hex(e), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal elements as a share of those that either has (0 to 1); two empty fingerprints are equal."""
    index = lambda e: F.shiftright(e, 32)
    either = F.size(F.array_union(F.transform(a, index), F.transform(b, index)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _cut(value: Column, cuts: Column) -> Column:
    """How many of ``cuts`` are at most ``value``."""
    return F.size(F.filter(cuts, lambda c: c <= value))


def _coded(text: Column, at: Column) -> Column:
    """The six bytes of ``text`` from byte ``at`` on and how many there are (7: more), as a long. Texts alike up to ``at`` compare as their codes do, or have the same."""
    whole = F.encode(text, "UTF-8")
    six = F.conv(F.rpad(F.hex(F.substring(whole, at + 1, F.lit(6))), 12, "0"), 16, 10).cast("long")
    return six * 8 + F.greatest(F.least(F.octet_length(text) - at, F.lit(7)), F.lit(0))


def _alike(a: Column, b: Column) -> Column:
    """How many first bytes two texts share: bit by bit of that number, largest first."""
    a, b = F.encode(a, "UTF-8"), F.encode(b, "UTF-8")
    shortest = F.least(F.octet_length(a), F.octet_length(b))
    fits = lambda n: (n <= shortest) & (F.substring(a, F.lit(1), n) == F.substring(b, F.lit(1), n))
    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), F.lit(0), lambda n, bit: F.when(fits(n + bit), n + bit).otherwise(n))


def _down(table: Column, text: Column) -> Callable[[Column, Column], Column]:
    """The step from a node to the next one that ``text`` belongs to, if ``table`` has ways for the node."""

    def step(now: Column, _: Column) -> Column:
        to = lambda way: let(_coded(text, way["at"]), lambda code: F.struct((way["to"] + _cut(code, way["cuts"])).alias("node"), code.alias("start")))
        return let(F.get(table, now["node"]), lambda way: F.when(way.isNull(), now).otherwise(to(way)))

    return step


def _parted(rows: DataFrame, tie: str, first: int, each: int, most_parts: int = 256) -> tuple[DataFrame, dict[int, tuple], dict[int, int]]:
    """``rows`` with _node parted further by ``tie`` until a node has about ``each`` rows, and _start; the order of the nodes made; nodes of equal rows: how many.

    ``rows`` has a node's number in _node; new ones count from ``first``. In each round the nodes with too many rows are parted by
    quantiles of what follows the bytes that all their rows share, so long common beginnings take one round and rounds are about as many as the
    places where many texts part. Each round reads ``rows`` twice; a row for each node comes to the driver.
    """
    order: dict[int, tuple] = {}
    copies: dict[int, int] = {}
    ways: dict[int, dict] = {}  # of parted nodes: the byte to look at, cuts of the codes there, the first node they lead to
    place = F.struct(F.col("_node").cast("int").alias("node"), F.lit(0).cast("long").alias("start"))
    placed, looked_at = rows.withColumn("_place", place), None
    rounds = 0
    while True:
        # one expression goes down all rounds, so that plans do not grow with them
        open_ = placed if looked_at is None else placed.where(F.col("_place.node").between(*looked_at))
        open_ = open_.select(F.col("_place.node").alias("_node"), tie)
        ends = open_.groupBy("_node").agg(F.count("*").alias("n"), F.min(tie).alias("lo"), F.max(tie).alias("hi")).where(F.col("n") > 2 * each)
        found = ends.select("_node", "n", (F.col("lo") == F.col("hi")).alias("same"), _alike(F.col("lo"), F.col("hi")).alias("at")).collect()
        copies |= {r["_node"]: r["n"] for r in found if r["same"]}
        wide = {r["_node"]: r for r in found if not r["same"]}
        if not wide:
            break
        places = F.from_json(F.lit(json.dumps([wide[i]["at"] if i in wide else None for i in range(max(wide) + 1)])), "array<int>")
        most = min(most_parts, max(-(-r["n"] // each) for r in wide.values()))
        codes = open_.withColumn("_at", F.get(places, F.col("_node"))).where("_at is not null").select("_node", _coded(F.col(tie), F.col("_at")).alias("_code"))
        begun = first
        for r in sorted(codes.groupBy("_node").agg(F.percentile_approx("_code", [i / most for i in range(1, most)], 20 * most).alias("c")).collect(), key=lambda r: r["_node"]):
            step = max(1, most * each // wide[r["_node"]]["n"])
            # a code that several quantiles have gets a node of its own
            cuts = sorted({*r["c"][step - 1 :: step], *r["c"][:1], *[c + 1 for c, m in Counter(r["c"]).items() if m > 1]})
            ways[r["_node"]] = {"at": wide[r["_node"]]["at"], "cuts": cuts, "to": first}
            order |= {first + i: (*order.get(r["_node"], (r["_node"],)), i) for i in range(len(cuts) + 1)}
            first += len(cuts) + 1
        looked_at = (begun, first - 1)
        rounds += 1
        table = F.from_json(F.lit(json.dumps([ways.get(i) for i in range(max(ways) + 1)])), "array<struct<at:int,cuts:array<bigint>,to:int>>")
        placed = rows.withColumn("_place", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), place, _down(table, F.col(tie))))
    return placed.select(*[c for c in rows.columns if c != "_node"], F.col("_place.node").alias("_node"), F.col("_place.start").alias("_start")), order, copies


def _bucketed(docs: DataFrame, key: str, tie: str, rows_per_bucket: int, most_buckets: int) -> DataFrame:
    """``docs`` with _bucket and _end: buckets of rows that follow each other by (key, tie), and behind each bucket's rows (_end 1) the first row of the next one.

    Quantiles of the key part the rows. A key that holds many quantiles has a bucket of its own, which is parted further by ``tie``
    (:func:`_parted`); rows equal in both are dealt by numbers of their own, in any order.
    """
    spark = docs.sparkSession
    n = docs.count()
    buckets = max(1, min(most_buckets, -(-n // rows_per_bucket)))
    each = max(rows_per_bucket, -(-n // most_buckets))
    k = F.coalesce(F.col(key), F.lit(_LOWEST))
    found = docs.agg(F.percentile_approx(k, [i / buckets for i in range(1, buckets)], min(20 * buckets, 1_000_000))).first()[0] if buckets > 1 else []
    times = Counter(found or [])
    hot = {c: m for c, m in times.items() if m >= max(4, buckets // 256)}  # 256 keys at most
    cuts = sorted({*times, *[c + 1 for c in hot]})
    side = max(1, int(len(cuts) ** 0.5))
    table = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    bucket = F.lit(0)
    if table:
        rows = F.from_json(F.lit(json.dumps(table)), "array<array<bigint>>")
        row = _cut(k, F.from_json(F.lit(json.dumps([r[0] for r in table])), "array<bigint>"))
        bucket = F.when(row == 0, F.lit(0)).otherwise((row - 1) * side + _cut(k, F.get(rows, row - 1)))
    cut = docs.withColumn("_bucket", bucket.cast("int"))
    begin = F.lit(0).cast("long")
    if hot:
        parted, order, copies = _parted(cut.where(k.isin(*hot)).withColumnRenamed("_bucket", "_node"), tie, len(cuts) + 1, each)
        part = F.lit(0)
        if copies:
            shares = F.from_json(F.lit(json.dumps([-(-copies[i] // each) if i in copies else None for i in range(max(copies) + 1)])), "array<int>")
            share = F.get(shares, F.col("_node").cast("int"))
            equal = staged(salted(parted.where(share.isNotNull()), "_copy"), "equal-rows")
            parted = parted.where(share.isNull()).withColumn("_copy", F.lit(0).cast("long")).unionByName(equal)
            part = F.coalesce(F.pmod(F.xxhash64("_copy"), share), F.lit(0))
        # numbers in the order of the nodes, one for each share of equal rows
        nodes = sorted({**{b: (b,) for b in range(len(cuts) + 1)}, **order}.items(), key=lambda x: x[1])
        numbers, at = {}, 0
        for node, _ in nodes:
            numbers[node] = at
            at += -(-copies[node] // each) if node in copies else 1
        number = F.from_json(F.lit(json.dumps([numbers[i] for i in range(len(numbers))])), "array<int>")
        parted = parted.select(*docs.columns, (F.get(number, F.col("_node").cast("int")) + part).cast("int").alias("_bucket"), "_start")
        cut = cut.where(~k.isin(*hot)).select(*docs.columns, F.get(number, F.col("_bucket")).alias("_bucket"), begin.alias("_start")).unionByName(parted)
        begin = F.col("_start")
    # each bucket's first row: the smallest key and start of its tie by bucket come to the driver, rows that have them are compared whole
    lows = cut.select("_bucket", F.struct(k.alias("k"), begin.alias("s")).alias("m")).groupBy("_bucket").agg(F.min("m").alias("m")).collect()
    lows = sorted((r["_bucket"], r["m"]["k"], r["m"]["s"]) for r in lows)
    before = [{"_of": b, "_k": x, "_s": y, "_to": lows[i - 1][0]} for i, (b, x, y) in enumerate(lows)]
    ends = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(before)), "array<struct<_of:int,_k:bigint,_s:bigint,_to:int>>")))
    first = cut.withColumns({"_k": k, "_s": begin}).join(F.broadcast(ends.withColumnRenamed("_of", "_bucket")), ["_bucket", "_k", "_s"])
    heads = first.groupBy("_to").agg(F.min_by(F.struct(*docs.columns), tie).alias("_head")).select("_head.*", F.col("_to").alias("_bucket"), F.lit(1).alias("_end"))
    return cut.select(*docs.columns, "_bucket").withColumn("_end", F.lit(0)).unionByName(heads)


def with_next(docs: DataFrame, key: str, columns: list[str], tie: str, rows_per_bucket: int = 512, most_buckets: int = 65_536) -> DataFrame:
    """``docs`` with next_<column> for each of ``columns``: that of the row after it by (key, tie), the last one's being the first row's.

    Quantiles part the rows into buckets, which are ordered each on its own. The first row of a bucket is
    added to the bucket before it, so that every row finds its successor in its bucket. What comes to the driver: the
    quantiles and the buckets' numbers, about ``most_buckets`` at most (which bounds the driver's memory); of more rows a bucket has a
    share of ``1 / most_buckets``, and is sorted with spills. A null key counts as the smallest.
    """
    order = Window.partitionBy("_bucket").orderBy("_end", key, tie)
    led = _bucketed(docs, key, tie, rows_per_bucket, most_buckets).select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return led.where("_end = 0").drop("_bucket", "_end")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, elements: int = ELEMENTS, rows_per_bucket: int = 512, most_buckets: int = 65_536) -> DataFrame:
    """A row for each document: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last half (rounded down) of code points replaced by as many first ones of the next document
    by key, or all of it; after the last comes the first, which is a lone document itself. A null text is empty. Repeated
    rows follow each other; of rows with equal keys the smaller text comes first. An empty table gives no rows; other
    columns are ignored. Texts are shuffled once, as they are; fingerprints are made where their rows then lie in order.
    """
    own = docs.select(F.col(key).cast("long").alias(key), text_of(text).alias("_text"))
    order = Window.partitionBy("_bucket").orderBy("_end", key, "_text")
    half = F.floor(F.char_length("_text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.char_length("_text") - half), F.substring(F.lead("_text").over(order), F.lit(1), half))
    led = _bucketed(own, key, "_text", rows_per_bucket, most_buckets).withColumn("_edited", edited)
    led = with_elements(led, "_text", "_own", k, elements).withColumn("_next", F.lead("_own").over(order)).where("_end = 0")
    led = led.select(key, F.char_length("_text").cast("long").alias("n_chars"), "_own", "_next", "_edited")
    both = with_elements(led, "_edited", "_new", k, elements)
    return both.select(key, "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), written(F.col("_own")).alias("fingerprint"), written(F.col("_new")).alias("edited_fingerprint"), likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_next")).alias("near_next"))
