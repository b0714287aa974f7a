import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarrylight.llm import bin_packing, entry, hash_tree, kneser_ney, ngram_join
from tests.llm.conftest import frame, words


def grams(t):
    w = (t or "").lower().encode().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts):
    """Links among distinct sets, class of each document, number of links."""
    sets = {i: grams(t) for i, t in texts.items()}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    inverted, linked = defaultdict(list), defaultdict(set)
    for s, i in first.items():
        shared = Counter(j for g in s for j in inverted[g])
        for j, n in shared.items():
            other = sets[j]
            if n >= 0.8 * (len(s) + len(other) - n) - 1e-9:
                linked[i].add(j)
                linked[j].add(i)
        for g in s:
            inverted[g].append(i)
    parent = {}

    def find(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a in linked:
        for b in linked[a]:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    size = Counter(first[s] for s in sets.values())
    return {i: find(first[s]) for i, s in sets.items()}, {i: size[first[s]] - 1 + sum(size[j] for j in linked[first[s]]) for i, s in sets.items()}


def near_copies(seed, n, share):
    """A text and ``n`` variants with words replaced."""
    rng = random.Random(seed)
    base = words(120, seed, 3000).split()
    out = [" ".join(base)]
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(len(w)), max(1, int(share * len(w) * rng.random()))):
            w[at] = f"w{rng.random()}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small", [1, 8])
def test_join_by_brute_force(spark, small):
    texts = dict(enumerate([*near_copies(1, 90, 0.06), *near_copies(2, 5, 0.04), *near_copies(3, 1, 0.02), *[words(120, 50 + i, 3000) for i in range(40)], *[words(60, 9)] * 20, "a b c", "a b c", "A  B c", "a b d", "", "", None]))
    rows, links = ngram_join.join(frame(spark, list(texts.items())), small=small)
    rows, (classes, n_links) = rows.collect(), brute(texts)
    assert {r.doc_id: r.class_id for r in rows} == classes
    assert {r.doc_id: r.n_links for r in rows} == n_links
    assert all(r.jaccard >= 0.8 and r.a < r.b for r in links.collect())


def test_join_of_the_fixture_by_brute_force(spark, sf, texts):
    rows = entry.op2_ngram_jaccard_join(spark, sf).collect()
    classes, n_links = brute(texts)
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (classes[i], n_links[i]) for i in texts}


def test_bands_reach_the_recall():
    bands, rows = ngram_join.choose_bands(0.8, 0.9995)
    assert (1 - 0.8**rows) ** bands <= 0.0005 and bands * rows <= 128
    with pytest.raises(ValueError):
        ngram_join.choose_bands(0.05, 0.9999999, 4)


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (105, 101), (7, 7)]
    got = {r.node: r.component for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 105), 100)}


def test_similarities_by_chunks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n, dtype=np.uint64)) for n in (1, 5, 50, 200, 0)]
    s = ngram_join.similarities(sets, sets, width=7)
    for (i, a), (j, b) in itertools.product(enumerate(sets), repeat=2):
        union = len(np.union1d(a, b))
        assert abs(s[i, j] - (len(np.intersect1d(a, b)) / union if union else 0)) < 1e-6


def test_join_takes_odd_tables(odd, nothing):
    rows, links = ngram_join.join(odd)
    got = rows.collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[8].class_id == by[9].class_id == 8 and by[1].n_links == 1 and by[2].class_id == by[6].class_id != by[1].class_id
    rows, links = ngram_join.join(nothing)
    assert rows.count() == 0 and links.count() == 0


def tokens(t):
    return [w.decode() for w in (t or "").encode().lower().split()] + ["</s>"]


def reference_model(texts):
    c, b = Counter(), Counter()
    for t in texts:
        w = tokens(t)
        c.update(w)
        b.update(zip(["<s>", *w[:-1]], w, strict=True))

    def discounts(n):
        n = [sum(v == k for v in n.values()) for k in (1, 2, 3, 4)]
        if min(n) <= 0:
            d = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.5
            return [0] + [min(d, 0.9)] * 3
        y = n[0] / (n[0] + 2 * n[1])
        return [0] + [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]

    before = Counter(w for _, w in b)
    d, e = discounts(b), discounts(before)
    total, follow = Counter(), defaultdict(lambda: [0] * 4)
    for (v, w), n in b.items():
        total[v] += n
        follow[v][min(n, 3)] += 1
    unseen = sum(e[min(n, 3)] for n in before.values()) / len(b) / (len(c) + 1)

    def p(v, w):
        alone = (before[w] - e[min(before[w], 3)]) / len(b) + unseen if w in before else unseen
        if v not in total:
            return alone
        n = b.get((v, w), 0)
        return (n - d[min(n, 3)]) / total[v] + sum(d[i] * follow[v][i] for i in (1, 2, 3)) / total[v] * alone

    return c, p


def test_kneser_ney_by_brute_force(spark, sf, texts):
    got = {r.doc_id: r for r in entry.op6_kneser_ney(spark, sf).collect()}
    c, p = reference_model(t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5 != 1)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        w, r = tokens(t), got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(p(a, b)) for a, b in zip(["<s>", *w[:-1]], w, strict=True)), rel_tol=1e-5)
    apart = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in apart) > sum(r.base_score for r in apart)
    vocabulary = [*c, "never seen"]
    assert math.isclose(sum(p("the", w) for w in vocabulary), 1, rel_tol=1e-6)


def test_kneser_ney_takes_odd_tables(odd, nothing, spark):
    for corpus in (odd, nothing, frame(spark, [(1, "a b a b")])):
        model = kneser_ney.train(corpus.select("text"))
        assert kneser_ney.score(odd, model).count() == odd.count()
        assert all(r.score <= 0 for r in kneser_ney.score(odd, model).collect())
        assert kneser_ney.score(nothing, model).count() == 0


def test_word_hashes_are_those_of_words():
    from quarrylight.llm.shared import word_hashes

    h, n = word_hashes([b"ab cd ab", b"", b" \t cd", "é ab".encode()])
    assert n.tolist() == [3, 0, 1, 2] and h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_shards_move_only_into_the_new_one(spark, sf, texts):
    rows = entry.op8_hash_tree_sharding(spark, sf).collect()
    by = defaultdict(list)
    for r in rows:
        t = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(t) + 1, zlib.crc32(t), "key")
        assert r.grown_shard in (r.shard, 8) and 0 <= r.shard < 8
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shares_follow_weights_and_movement_is_confined(spark):
    leaves = [(0, 0, 0, 1.0), (0, 0, 1, 3.0), (0, 1, 2, 4.0), (1, 2, 3, 8.0)]
    heavier = [*leaves[:1], (0, 0, 1, 6.0), *leaves[2:]]
    from pyspark.sql import functions as F

    df = spark.range(20_000).select(hash_tree.shard_of(F.col("id"), leaves).alias("a"), hash_tree.shard_of(F.col("id"), heavier).alias("b")).toPandas()
    share = df.a.value_counts(normalize=True)
    assert all(abs(share[s] - w / 16) < 0.015 for _, _, s, w in leaves)
    moved = df[df.a != df.b]
    # region 0 and rack 0 grew: rows move out of region 1 or out of rack 1 or shard 0, never into region 1
    assert len(moved) and not (moved.b == 3).any()
    inside = moved[moved.a.isin([0, 1, 2])]
    assert not (inside.b == 2).any() or (inside[inside.b == 2].a == 3).all()
    with pytest.raises(ValueError):
        hash_tree.shard_of(F.col("id"), [(0, 0, 0, 0.0)])


def test_sharding_takes_odd_tables(odd, nothing):
    assert hash_tree.assign_shards(odd).count() == odd.count()
    assert hash_tree.assign_shards(nothing).count() == 0


def fewest(items, capacity):
    """By search over sets for the largest item."""
    items = sorted(items, reverse=True)
    if not items:
        return 0
    rest = items[1:]
    best = len(items)
    for k in range(min(len(rest), 4) + 1):
        for chosen in set(itertools.combinations(range(len(rest)), k)):
            if items[0] + sum(rest[i] for i in chosen) <= capacity:
                best = min(best, 1 + fewest([x for i, x in enumerate(rest) if i not in chosen], capacity))
    return best


def test_reduction_keeps_the_optimum():
    rng = random.Random(2)
    for _ in range(120):
        items = [rng.randint(4, 20) for _ in range(rng.randint(1, 7))]
        counts = [0] * 21
        for x in items:
            counts[x] += 1
        fixed = bin_packing.reduce_dominated(counts)
        left = [x for x, n in enumerate(counts) for _ in range(n)]
        assert sorted(left + [x for p, n in fixed for x in p * n]) == sorted(items)
        assert sum(n for _, n in fixed) + fewest(left, 20) == fewest(items, 20)


def test_plans_hold_every_item_once():
    rng = random.Random(3)
    for most in (5, 100, 1024):
        histogram = Counter(rng.randint(1, most) for _ in range(3000))
        plan = bin_packing.solve(histogram)
        used = Counter()
        for p, n in plan:
            assert sum(p) <= 1024
            for x in p:
                used[x] += n
        assert used == histogram
        assert sum(n for _, n in plan) <= 1.02 * math.ceil(sum(x * n for x, n in histogram.items()) / 1024) + 2
    assert bin_packing.solve({}) == []


def test_packing_round_trip(spark, sf, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bin_packing._default_tokenizer()[0])
    check_packing(entry.op10_best_fit_packing(spark, sf).collect(), texts, tokenizer)


def check_packing(rows, texts, tokenizer):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(by) == set(texts)
    for i, own in by.items():
        ids = np.array([*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 1024 for r in own[1:]) and own[0].length <= 1024
        assert len(own) == -(-len(ids) // 1024)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 1024
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.1 * math.ceil(total / 1024) + 1


def test_ids_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    path, *rest = bin_packing._default_tokenizer()
    fast, slow = bin_packing.Ids(path, *rest), Tokenizer.from_file(path)
    odd = ["<|endoftext|> a", "\x1c\x1d x \x85 y", "a" * 3000, "  \n\n x", "日本語 テキスト", "é \U0001f600 ñ", "can't I'LL we've ’s", "   x\t\t y ", "１２³ ⅷ", "", "a<|endoftext|>b", "​⁠﻿ x", words(300, 3)]
    assert all(fast.encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids for t in odd)
    assert bin_packing.Ids(path).encode("x y").tolist() == slow.encode("x y").ids


def test_packing_takes_odd_tables(odd, nothing):
    rows = bin_packing.pack(odd).collect()
    assert sum(r.piece == 0 for r in rows) == odd.count()
    assert bin_packing.pack(nothing).count() == 0


def test_join_matches_duckdb(spark, sf):
    import duckdb

    from tests.oracle import difference, views

    con = duckdb.connect()
    views(con, sf)
    for name, sql in entry.oracle_sql().items():
        assert difference(entry.queries()[name](spark, sf), con, sql) == ""


def test_join_with_negative_missing_and_repeated_ids(spark):
    a, *near = near_copies(11, 12, 0.03)
    rows = [(-5, a), (-5, a), (7, a), *[(None, t) for t in near[:6]], *[(20 + i, t) for i, t in enumerate(near[6:])], (99, words(90, 77, 3000))]
    got = ngram_join.join(frame(spark, rows), small=2)[0].collect()
    keyed = {i: t for i, (_, t) in enumerate(rows)}
    classes, n_links = brute(keyed)
    groups = defaultdict(set)
    for i, c in classes.items():
        groups[c].add(rows[i][0])
    assert len({r.class_id for r in got}) == len(groups)
    assert sorted(r.n_links for r in got) == sorted(n_links.values())


def test_join_is_the_same_whatever_counts_as_large(spark):
    texts = dict(enumerate([*near_copies(21, 40, 0.12), *near_copies(22, 12, 0.1), *[words(60, 9)] * 9, *[words(120, 70 + i, 3000) for i in range(10)]]))
    got = set()
    for small in (1, 8, 10**6):
        rows, _ = ngram_join.join(frame(spark, list(texts.items())), recall=0.6, small=small)
        got.add(tuple(sorted((r.doc_id, r.class_id, r.set_id, r.n_links) for r in rows.collect())))
    assert len(got) == 1


def test_row_keys_tell_rows_apart(spark):
    from quarrylight.llm.shared import row_keys

    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e"), (None, "d"), (None, None), (None, ""), (-7, "f"), (-7, "g"), (-8, "h")]
    got = row_keys(frame(spark, rows), "k").collect()
    by = defaultdict(set)
    for r in got:
        by[r.k].add((r.doc_id, r.text or ""))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({(i, t or "") for i, t in rows})
    assert {r.k for r in got if r.doc_id in (2, -8)} == {2, -8}


def test_rows_that_share_a_key_draw_again(spark):
    from quarrylight.llm.shared import row_keys

    rows = [(None, f"t{i % 70}") for i in range(90)] + [(5, "a"), (5, "b"), (-3, "c"), (7, "d")]
    docs = frame(spark, rows)
    got = {bits: row_keys(docs, "k", bits=bits).collect() for bits in (8, 62)}
    for bits, have in got.items():
        by = defaultdict(set)
        for r in have:
            by[r.k].add((r.doc_id, r.text))
        assert len(have) == len(rows) and all(len(v) == 1 for v in by.values()) and len(by) == len(set(rows))
        assert {r.k for r in have if r.doc_id in (-3, 7)} == {-3, 7}
        again = {r.k for r in have if r.k < -(1 << bits)}
        assert (0 < len(again) < 70) if bits == 8 else not again


def test_numbers_without_gaps_in_hot_groups(spark):
    from pyspark.sql import functions as F

    from quarrylight.llm.shared import numbered, salted, staged

    df = staged(salted(spark.range(1000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 4).alias("g"), F.lit("same").alias("x")), "s"), "t")
    by = defaultdict(list)
    for r in numbered(df, ["g"], ["x", "s"], "n", rows_per_bucket=20).collect():
        by[r.g].append(r.n)
    assert len(by) == 5 and all(sorted(v) == list(range(len(v))) for v in by.values())


def test_kneser_ney_of_doubled_texts_stays_finite(spark):
    rows = [(i, t) for i, t in enumerate([words(40, k, 300) for k in range(20)] * 2)]
    model = kneser_ney.train(frame(spark, rows).select("text"))
    unseen = frame(spark, [(1, words(50, 99, 300)), (2, "never seen words at all"), (3, None), (4, words(30_000, 5, 400))])
    assert all(math.isfinite(r.score) and math.isfinite(r.perplexity) and r.score < 0 for r in kneser_ney.score(unseen, model).collect())
    assert min(model.discounts) > 0


def test_kneser_ney_is_the_same_in_any_number_of_shards(spark, small):
    scores = []
    for tokens in (1_000_000, 300):
        model = kneser_ney.train(small.select("text"), tokens)
        scores.append({r.doc_id: r.score for r in kneser_ney.score(small, model).collect()})
    assert model.shards > 16 and len(model.hot) > 2
    assert all(math.isclose(x, scores[1][i], rel_tol=1e-6) for i, x in scores[0].items())
    # keys know their bigrams, also where ids need more than 32 bits
    wide = kneser_ney.Model("", starts=np.array([0, 1 << 35]), shards=1 << 20, hot=np.array([5, 1 << 34, 1 << 35]))
    rng = np.random.default_rng(3)
    context, word = np.concatenate((rng.integers(0, 1 << 35, 500), wide.hot)), rng.integers(0, 1 << 35, 503)
    shard, key = wide.coded(context, word)
    got = [tuple(int(x[0]) for x in wide.decoded(int(s), np.array([k]))) for s, k in zip(shard, key, strict=True)]
    assert got == list(zip(context.tolist(), word.tolist(), strict=True))
    for bits in (3, 40):
        s, k = rng.integers(0, 1 << 30, 4000).astype(np.int32), rng.integers(0, 1 << bits, 4000, dtype=np.uint64)
        s[:2000], k[:2000] = s[2000:], k[2000:]
        a, b, n = kneser_ney._summed(s, k, None)
        assert dict(zip(zip(a.tolist(), b.tolist(), strict=True), n.tolist(), strict=True)) == Counter(zip(s.tolist(), k.tolist(), strict=True))
        assert [(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)] == sorted(zip(a.tolist(), b.tolist(), strict=True))
    for keys in (np.array([3], np.uint64), np.array([1, 5, 1 << 40, (1 << 63) + 7], np.uint64), np.arange(9, dtype=np.uint64)):
        assert kneser_ney.unpacked(kneser_ney.packed(keys)).tolist() == keys.tolist()


def test_shards_by_brute_force(spark, sf, texts):
    import xxhash

    def draw(key, salt):
        seed = xxhash.xxh64_intdigest((key & (1 << 64) - 1).to_bytes(8, "little"), 42)
        return -math.log(((xxhash.xxh64_intdigest(salt.encode(), seed) >> 11) + 0.5) / (1 << 53))

    def descend(key, leaves):
        at = None
        for level, name in enumerate(("region", "rack", "shard")):
            below = Counter()
            for x in leaves:
                if level == 0 or x[level - 1] == at:
                    below[x[level]] += x[3]
            at = min(below, key=lambda n: (draw(key, f"{name}/{n}") / below[n], n))
        return at

    leaves = hash_tree.tree(8)
    for r in entry.op8_hash_tree_sharding(spark, sf).collect():
        assert (r.shard, r.grown_shard) == (descend(r.doc_id, leaves), descend(r.doc_id, hash_tree.grown(leaves)))


def test_counted_joins_split_hot_keys(spark):
    from pyspark.sql import functions as F

    from quarrylight.llm.shared import join_counted

    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n")).where("k <> 7")
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    for most in (10**6, 0):
        assert sorted(map(tuple, join_counted(rows, table, ["k"], "n", most, 50).collect())) == want
