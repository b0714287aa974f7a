"""What operators give for nulls, empty and long texts, repeated rows and clashing columns: the results that their docstrings state."""

import hashlib
import math
import zlib

import pytest

from quarrylight.llm import bin_packing, decontaminate, hash_tree, kneser_ney, license_index, order_minhash, pii_surrogates, secret_scan, toxicity
from tests.llm.conftest import CLASHES, frame, words


def rows_of(df):
    """Rows by (doc_id, text) of the odd table."""
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.fixture(scope="module")
def source(odd):
    return [(r.doc_id, r.text) for r in odd.collect()]


def kept(rows, replaced):
    gone = {c.lower() for c in replaced}
    return all(r[c] == "clash" for r in rows for c in CLASHES if c.lower() not in gone)


def test_secret_spans(odd, source):
    rows = rows_of(secret_scan.scan(odd))
    assert len(rows) == len(source) and all(r["spans"] == [] for r in rows) and kept(rows, ("spans",))


def test_surrogates(odd, source):
    rows = rows_of(pii_surrogates.replace(odd))
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, source))  # nothing personal in it
    assert all(r["entities"] == [] for r in rows) and kept(rows, ("entities",))


def test_fingerprints(odd, source):
    rows = rows_of(order_minhash.fingerprints(odd))
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in rows) == sorted((str(i), len(t or "")) for i, t in source)
    ordered = sorted(((-(2**63) if i is None else i, t or "") for i, t in source), key=lambda x: (x[0], x[1].encode()))
    want = []
    for k, (i, t) in enumerate(ordered):
        nxt, half = ordered[(k + 1) % len(ordered)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted((-(2**63) if r["doc_id"] is None else r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == sorted(want)
    assert all(r["fingerprint"] == "" for r in rows if r["doc_id"] in (2, 3, 6))


def test_perplexity(odd, source):
    model = kneser_ney.train(odd.select("text"))
    rows = rows_of(kneser_ney.score(odd, model))
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and math.isfinite(r["perplexity"]) for r in rows)
    empty = [r for r in rows if r["doc_id"] in (2, 3, 6)]
    assert {r["n_tokens"] for r in empty} == {1} and len({r["score"] for r in empty}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1 and len({r["score"] for r in rows if r["doc_id"] in (8, 9)}) == 1


def test_toxicity(odd, source):
    rows = rows_of(toxicity.score_toxicity(odd, toxicity.Model({" idiot ": 3.0})))
    assert len(rows) == len(source) and {(r["hits"], r["toxic_weight"], r["predicted"]) for r in rows} == {(0, 0.0, 0)} and len({r["score"] for r in rows}) == 1
    assert kept(rows, ("score", "predicted", "hits", "toxic_weight"))


def test_shards(odd, source):
    rows = rows_of(hash_tree.assign_shards(odd))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in source)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1 and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)


def test_licences(odd, source):
    rows = rows_of(license_index.scan(odd))
    assert len(rows) == len(source) and all(r["base"] == [] and r["found"] == [] for r in rows) and kept(rows, ("base", "found", "n_words"))
    assert {r["n_words"] for r in rows if r["doc_id"] in (2, 3, 6)} == {0} and {r["n_words"] for r in rows if r["doc_id"] == 4} == {30_000}


def test_packing_of_very_long_words(spark):
    from tokenizers import Tokenizer

    from tests.llm.test_corpus import check_packing

    texts = {1: "x" * 200_000, 2: "日本" * 40_000, 3: "a1" * 60_000 + " " + words(50, 1), 4: None}
    check_packing(bin_packing.pack(frame(spark, list(texts.items()))).collect(), texts, Tokenizer.from_file(bin_packing._default_tokenizer()[0]))


def test_ids_of_fuzzed_texts_are_those_of_tokenizers(texts):
    import random

    from tokenizers import Tokenizer

    path, *rest = bin_packing._default_tokenizer()
    fast, slow = bin_packing.Ids(path, *rest), Tokenizer.from_file(path)
    rng = random.Random(8)
    pools = [(0x20, 0x7E), (0xA0, 0x24F), (0x370, 0x52F), (0x590, 0x6FF), (0x2000, 0x206F), (0x3000, 0x30FF), (0x4E00, 0x4F00), (0x1F300, 0x1F640), (0x0, 0x1F), (0x300, 0x36F), (0xFE00, 0xFE0F), (0xE000, 0xE010)]
    for _ in range(1500):
        t = "".join(chr(rng.randint(*rng.choice(pools))) for _ in range(rng.randint(0, 40)))
        assert fast.encode(t).tolist() == slow.encode(t, add_special_tokens=False).ids, repr(t)
    for t in texts.values():
        assert fast.encode(t or "").tolist() == slow.encode(t or "", add_special_tokens=False).ids


def test_leaks_in_very_long_words(spark):
    bench = spark.createDataFrame([(1, words(30, 1)), (2, "y" * 100_000)], "item_id long, text string")
    rows = [(1, "x" * 300_000 + " " + words(30, 1)), (None, words(30, 1)), (3, "y" * 100_000), (4, " ".join(["a"] * 20_000))]
    for most in (10**6, 1):
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench, most_in_memory=most).collect()}
        assert got == {(1, 1), (None, 1), (3, 2)}
