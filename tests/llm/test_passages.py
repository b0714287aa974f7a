"""Token alignment, repair of conversations and removal of repeated passages, by brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarrylight.llm import entry, substring_dedup, token_alignment, turn_repair
from tests.llm.conftest import frame, words

# ---- op11 ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    import tokenizers

    files = token_alignment._default_tokenizers()
    a = tokenizers.Tokenizer.from_file(files.a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=files.b)
    return a, b, token_alignment.Encoder(files)


def plain_groups(text, libraries):
    """Tokens of the whole text, groups by walking both byte strings."""
    a, b, e = libraries
    if not text:
        return None
    ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    ba, bb = [e.bytes_a[i] for i in ia], [e.bytes_b[i] for i in ib]
    if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
        return None
    ea, eb = list(itertools.accumulate(map(len, ba))), list(itertools.accumulate(map(len, bb)))
    common = sorted(set(ea) & set(eb))
    groups = [([], []) for _ in common]
    for ends, ids, side in ((ea, ia, 0), (eb, ib, 1)):
        g = 0
        for end, i in zip(ends, ids, strict=True):
            groups[g][side].append(i)
            g += end == common[g]
    links = [(x, y) for x, (s, t) in enumerate(zip([0, *ea], ea)) for y in range(len(eb)) if ([0, *eb][y] < t and eb[y] > s)] if len(ea) < 400 else None
    return ia, ib, groups, links, ea, eb


def plain_report(texts, libraries):
    made = [plain_groups(t, libraries) for t in texts]
    pairs = []
    for m in made:
        if m is None:
            pairs.append([])
            continue
        ia, ib, _, links, ea, eb = m
        if links is None:  # long: sweep
            links, x, y = [], 0, 0
            while x < len(ea) and y < len(eb):
                links.append((x, y))
                p, q = ea[x] <= eb[y], eb[y] <= ea[x]
                x, y = x + p, y + q
        pairs.append([(ia[x], ib[y]) for x, y in links])
    count = Counter(p for ps in pairs for p in set(ps))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for m, ps in zip(made, pairs, strict=True):
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in m[2])
        out.append((len(m[0]), len(m[1]), len(m[2]), len(ps), sum(count[p] == best[p[0]] for p in ps), sum(count[p] for p in ps), hashlib.sha256(written.encode()).hexdigest()))
    return out


def reported(df):
    return sorted((str(r["doc_id"]), r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect())


def test_alignment_of_the_fixture_by_brute_force(spark, sf, small, libraries):
    rows = small.select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, plain_report([r.text for r in rows], libraries), strict=True))
    assert reported(entry.op11_token_alignment(spark, sf)) == want


@pytest.mark.parametrize("most_kept", [0, 40, 10**6])
def test_rare_pairs_are_counted_by_shuffle(spark, small, libraries, most_kept):
    rows = small.select("doc_id", "text").limit(25).collect()
    want = sorted((str(r.doc_id), *x) for r, x in zip(rows, plain_report([r.text for r in rows], libraries), strict=True))
    assert reported(token_alignment.align_tokens(spark.createDataFrame(rows), most_kept=most_kept)) == want


def test_alignment_of_odd_rows(odd, nothing, libraries):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = sorted((str(i), *x) for (i, _), x in zip(rows, plain_report([t for _, t in rows], libraries), strict=True))
    assert reported(token_alignment.align_tokens(odd)) == want
    assert token_alignment.align_tokens(nothing).count() == 0


def test_words_have_the_tokens_of_the_whole_text(libraries):
    rng = random.Random(3)
    pools = [" ", "  ", "\n", "\t ", " \n", " ", "　 ", "\x1c", "\x85 ", "a", "Dogs", "'ll", "12", "<|endoftext|>", "</s>", "<unk>", "▁", "▁ x", "é", "日本", "\U0001f600", "é", ".", ",\n", "ﬁ", "\x00", "don't"]
    for _ in range(1500):
        t = "".join(rng.choice(pools) for _ in range(rng.randint(1, 14)))
        m = plain_groups(t, libraries)
        x = token_alignment.block(libraries[2], [t])
        assert (x.ids_a.tolist(), x.ids_b.tolist()) == ((m[0], m[1]) if m else ([], [])), repr(t)
        if m:
            a, b = np.cumsum(x.moves & 1) - (x.moves & 1), np.cumsum(x.moves >> 1) - (x.moves >> 1)
            assert list(zip(a.tolist(), b.tolist(), strict=True)) == m[3], repr(t)


def test_runs_of_any_length_are_skipped():
    rng = random.Random(5)
    for n in (1, 2, 3, 5, 40, 3000):
        for share in (0.0, 0.02, 0.5, 1.0):
            ends = np.cumsum([rng.randint(1, 4) for _ in range(n)])
            drop = lambda: np.array([e for e in ends[:-1] if rng.random() >= share] + [ends[-1]])
            ea, eb = drop(), drop()
            a, b = token_alignment.align(ea, eb, np.array([0, len(ea)]), np.array([0, len(eb)]))
            walk, x, y = [], 0, 0
            while x < len(ea) and y < len(eb):
                walk.append((x, y))
                p, q = ea[x] <= eb[y], eb[y] <= ea[x]
                x, y = x + p, y + q
            assert list(zip(a.tolist(), b.tolist(), strict=True)) == walk


# ---- op12 ------------------------------------------------------------------------------------------------------------


def plain_repair(rows):
    """(blank, duplicate, truncated, illegal, cost, audit, text) of (role, text) rows, by dynamic programming from the end."""
    seen, faults = set(), []
    for role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    legal = lambda s: re.fullmatch(r"(s?(ua)+)?", s)
    # states as prefixes of the grammar: what is still needed
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {(len(rows), q): (0, "") if q in ("", "a") else (99, "~") for q in ("", "s", "u", "a")}
    for i in range(len(rows), -1, -1):
        ways = {q: [best[i, q]] if i == len(rows) else [] for q in ("", "s", "u", "a")}
        if i < len(rows):
            role, t = rows[i][0], 3 * (faults[i] == "truncated")
            for q in ways:
                ways[q].append((best[i + 1, q][0] + 4, "D" + best[i + 1, q][1]))
                if faults[i] in ("", "truncated"):
                    then = {"s": "s" if q == "" else None, "u": "u" if nxt[q] == "u" else None, "a": "a" if nxt[q] == "a" else None}.get(role[:1])
                    if then:
                        ways[q].append((best[i + 1, then][0] + t, "K" + best[i + 1, then][1]))
                    ways[q].append((best[i + 1, nxt[q]][0] + 3 + t, "R" + best[i + 1, nxt[q]][1]))
        for _ in range(3):
            for q in ways:
                if ways[nxt[q]]:
                    ways[q].append((min(ways[nxt[q]])[0] + 3, "I" + min(ways[nxt[q]])[1]))
        for q in ways:
            best[i, q] = min(ways[q])
    cost, audit = best[0, ""]
    out, q, at = [], "", 0
    for c in audit:
        if c == "I":
            q = nxt[q]
            out.append(({"u": "user", "a": "assistant"}[q], ""))
            continue
        role, text = rows[at]
        at += 1
        if c == "K":
            q = role[:1]
            out.append((role, text))
        elif c == "R":
            q = nxt[q]
            out.append(({"u": "user", "a": "assistant"}[q], text))
    assert legal("".join(r[:1] for r, _ in out))
    illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in itertools.pairwise(rows))
    count = Counter(faults)
    return count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


TURNS = "conv_id long, turn long, role string, text string"


def random_rows(rng, n, conv):
    roles, texts = ("user", "assistant", "system", "tool", "", "User", "u"), ("Yes.", "no", "", " \t", "what?", "Right!  ", "x", "é…")
    return [(conv, t, rng.choice(roles[: rng.choice((3, 7))]), rng.choice(texts)) for t in range(n)]


def check_repair(spark, rows, table=None):
    table = table or spark.createDataFrame(rows, TURNS)
    made = turn_repair.repair(table)
    texts = {r.conv_id: r.repaired_sha256 for r in turn_repair.digests(made.rows).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), " " if role is None else role, " " if text is None else text))
    report = made.report.collect()
    assert len(report) == len(by)
    for r in report:
        ordered = sorted(by[r.conv_id])
        *want, said = plain_repair([x[1:] for x in ordered])
        turns = [t for (some, t), *_ in ordered if some]
        assert [r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit] == want, r
        assert r.gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        assert texts.get(r.conv_id, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(said.encode()).hexdigest()


def test_repairs_by_brute_force(spark):
    rng = random.Random(12)
    check_repair(spark, [x for c in range(300) for x in random_rows(rng, rng.randint(1, 9), c)])


def test_long_conversations_are_cut_into_segments(spark):
    rng = random.Random(13)
    rows = [x for c in range(3) for x in random_rows(rng, 700, c)]
    check_repair(spark, [(c, t, r, f"{x}{rng.randint(0, 300)}{'.' * rng.randint(0, 1)}") for c, t, r, x in rows])


def test_segments_put_together_are_the_whole():
    rng = random.Random(14)
    for _ in range(400):
        codes = "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 12)))
        whole = turn_repair.over_segments([turn_repair.edges(codes, True)])
        cut = rng.randint(0, len(codes))
        parts = turn_repair.over_segments([turn_repair.edges(codes[:cut], True), turn_repair.edges(codes[cut:], False)])
        assert parts[0] == whole[0] and "".join(p for _, p in parts[1]) == whole[1][0][1]
        assert turn_repair.lightest(codes, 0, turn_repair.GOALS, False) and min(turn_repair.lightest(codes, 0, turn_repair.GOALS, True).values())[0] == whole[0]


def test_odd_conversations(spark):
    from pyspark.sql import functions as F

    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (None, 3, "user", "Hi."), (1, None, "assistant", "a."), (1, 5, "user", "long " * 20_000 + "."), (1, 5, "user", "long " * 20_000 + "."), (2, -7, "system", None), (2, 9, "system", "s."), (3, 1, "", "."), (4, 2, "user", " ")]
    table = spark.createDataFrame(rows, TURNS)
    check_repair(spark, rows, table.withColumns({c: F.lit("clash") for c in ("k", "seg", "audit", "salt", "said", "first", "code", "gaps")}))
    none = table.where("false")
    assert turn_repair.repair(none).report.count() == 0 and turn_repair.digests(turn_repair.repair(none).rows).count() == 0
    alone = turn_repair.repair(none, every=table).report.collect()
    assert sorted(str(r.conv_id) for r in alone) == ["1", "2", "3", "4", "None"] and {(r.gaps, r.cost, r.audit) for r in alone} == {(0, 0, "")}


def test_damage(spark):
    rows = [(c, t, "assistant", "Well. So!") for c in (1, None) for t in (*range(60), None)]
    got = Counter(map(tuple, turn_repair.damage(spark.createDataFrame(rows, TURNS)).collect()))
    want = Counter()
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want[c, t, "user" if kind == 4 else role, "" if kind == 1 else "Well So" if kind == 2 else text] += {0: 0, 3: 2}.get(kind, 1)
    assert got == +want


# ---- op13 ------------------------------------------------------------------------------------------------------------


def plain_removal(rows, k=13):
    first = {}
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    for i, w in split:
        for at in range(len(w) - k + 1) if i is not None else ():
            key = tuple(w[at : at + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in split:
        gone = {at + x for at in (range(len(w) - k + 1) if i is not None else ()) if first[tuple(w[at : at + k])] < i for x in range(k)}
        out.append((str(i), len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone)))
    return sorted(out)


def removed(df, **more):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df, **more).collect())


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(7)
    shared = [words(n, 900 + n) for n in (13, 14, 20, 60, 200)]
    rows = []
    for i in range(250):
        parts = [words(rng.randint(0, 60), 1000 + i, 40)]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), words(rng.randint(0, 9), 5000 + rng.randint(0, 99))]
        rows.append((rng.randint(0, 400), " ".join(parts)))
    rows += [(1000 + i, shared[4]) for i in range(60)]  # copies
    rows += [(2000 + i, f"{shared[3]} {words(30, 3000 + i)}") for i in range(40)]
    rows += [(3000, "a " * 5000), (3001, "a " * 300 + "b"), (3002, "a " * 12), (None, shared[3]), (None, None), (5, None), (6, ""), (7, shared[2]), (7, shared[2] + " and more"), (7, shared[2]), (-4, shared[1])]
    return rows


@pytest.mark.parametrize("hot_share", [1e-5, 1e-3, 0.02])
def test_repeats_by_brute_force(spark, passages, hot_share):
    assert removed(frame(spark, passages).repartition(5), hot_share=hot_share) == plain_removal(passages)


def test_hot_windows_are_found_and_answered_from_a_table(spark, passages):
    rows = substring_dedup._tagged(frame(spark, passages).repartition(3), "doc_id", "text")
    minimisers, windows, total = substring_dedup._hot(rows, 13, 1e-3)
    assert len(minimisers) and len(windows) and total == sum(max(0, len((t or "").split()) - 12) for _, t in passages)
    assert removed(frame(spark, passages).repartition(3), hot_share=1e-3) == plain_removal(passages)


def test_other_window_lengths(spark, passages):
    for k in (2, 3, 5):
        assert removed(frame(spark, passages[:80]), k=k) == plain_removal(passages[:80], k)


def test_equal_hashes_of_different_windows(passages):
    """Hashes of one bit: everything meets, and comparing words still tells windows apart."""
    strings = [b" ".join(t.encode().split()) for _, t in passages[:60] if t]
    text, first, h = substring_dedup._windows(strings, 13)
    best = substring_dedup._least_documents(strings, text, first, h & np.uint64(1), np.arange(len(strings), dtype=np.int64), 13)
    least = {}
    for t, s in enumerate(strings):
        w = s.split()
        for at in range(len(w) - 12):
            least.setdefault(tuple(w[at : at + 13]), t)
    for t, at, b in zip(text.tolist(), first.tolist(), best.tolist(), strict=True):
        assert least[tuple(strings[t].split()[at : at + 13])] == b


def test_repeats_of_odd_rows(odd, nothing, spark):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert removed(odd) == plain_removal(rows)
    assert substring_dedup.remove_repeats(nothing).count() == 0
    assert removed(spark.createDataFrame([], "doc_id long, text string")) == []


# ---- op5: recall under substitutions ------------------------------------------------------------------------------------


def replaced_recall(length, share, n=200, seed=5):
    """Of items of which ``share`` of the tokens are replaced at random places, inside other text, the share that is found; only those count that still hold half."""
    rng = np.random.default_rng(seed)
    from quarrylight.llm import decontaminate

    found = promised = 0
    items = [rng.integers(1, 1 << 62, length).astype(np.uint64) for _ in range(n)]
    held = decontaminate.Items(list(range(n)), items, decontaminate.MASKS)
    for i, item in enumerate(items):
        changed = item.copy()
        places = rng.permutation(length)[: round(share * length)]
        changed[places] = rng.integers(1, 1 << 62, len(places)).astype(np.uint64)
        doc = np.concatenate((rng.integers(1, 1 << 62, 30).astype(np.uint64), changed, rng.integers(1, 1 << 62, 30).astype(np.uint64)))
        if length - len(places) < max(0.5 * length, min(8, 0.8 * length)):
            continue
        promised += 1
        found += any(j == i and decontaminate.judge(doc, item, d, 0.5, 8, 5) for j, d in held.hits(doc).items())
    return found / promised if promised else None


def test_leaks_with_tokens_replaced_at_random_places():
    for length, share, least in ((8, 0.1, 0.95), (12, 0.1, 0.99), (12, 0.2, 0.9), (16, 0.3, 0.85), (30, 0.3, 0.98), (30, 0.4, 0.9), (60, 0.4, 0.98), (60, 0.5, 0.9), (120, 0.5, 0.98)):
        assert replaced_recall(length, share) >= least, (length, share, replaced_recall(length, share))


def test_chance_does_not_add_up_over_diagonals():
    from quarrylight.llm import decontaminate

    rng = np.random.default_rng(9)
    item, doc = rng.integers(0, 20, 60).astype(np.uint64), rng.integers(0, 20, 3000).astype(np.uint64)
    assert decontaminate.judge(doc, item, range(-50, 2990), 0.5, 8, 5) is None
