"""Faults that the findings of the third round name."""

import pytest

from quarrylight import plans


@pytest.mark.parametrize("name", ["w1_outcomes", "w_distinct_events", "w1_phase_counts", "w2_windowed_counts"])
def test_results_of_streams_lie_in_files(spark, sf, name):
    """a table in the driver's memory has no files."""
    assert plans.queries()[name](spark, sf).inputFiles()
    assert not spark.catalog.tableExists(name)


def test_drained_without_rows(spark, tmp_path):
    from quarrylight.streaming import progress

    spark.range(0).selectExpr("id AS event_id", "current_timestamp() AS ts").write.parquet(str(tmp_path / "in"))
    events = progress.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp")
    got = progress.drained(progress.distinct_events(events).select("event_id"), str(tmp_path / "at"), "append")
    assert got.columns == ["event_id"] and got.count() == 0


def _overlapping_log(spark, path):
    """Events in twelve files that land one after the other, so more than one micro-batch: each goes over the same month, ids come
    again in other files and far apart, some are null."""
    for k in range(12):
        rows = spark.range(50).selectExpr(
            f"CASE WHEN id < 7 THEN id WHEN id > 7 THEN id + 50 * {k} END AS event_id", f"timestamp_ntz'2024-01-30' - make_dt_interval(CAST(id DIV 2 AS INT), {k}) AS ts",
            "id % 3 AS user_id", "element_at(array('signup', 'view', 'purchase', 'click', 'error'), CAST(id % 5 + 1 AS INT)) AS event_type",
        )
        rows.coalesce(1).write.mode("append").parquet(f"{path}/events.parquet")


def test_distinct_events_of_files_that_overlap_in_time(spark, tmp_path):
    """events of a later file are not late, and repeats in any file are one event. Counts and outcomes share the stream."""
    import duckdb

    from tests.oracle import difference, views

    _overlapping_log(spark, tmp_path)
    con = duckdb.connect()
    views(con, str(tmp_path))
    for name in ("w_distinct_events", "w1_phase_counts", "w2_windowed_counts", "w1_outcomes"):
        assert difference(plans.queries()[name](spark, str(tmp_path)), con, plans.oracle_sql()[name]) == "", name


def test_forms_of_one_address_with_other_fields_stay(spark):
    """two pages with one address each post a form of their own; equal requests are still one."""
    from pyspark.sql import functions as F

    from quarrylight.sources import records

    rows = [("post", "http://a.com/x", "page=1", 1), ("post", "http://a.com/x", "page=2", 2), ("POST", " http://a.com/x", "page=2", 3), ("get", "http://a.com/x", None, 4), ("", "http://a.com/x", None, 5)]
    flat = spark.createDataFrame(rows, "m string, u string, b string, seq long")
    part = f"struct({records.SCHEMAS['crawl']})".replace("struct(", "struct<", 1)[:-1] + ">"
    made = flat.select(F.from_json(F.to_json(F.struct(F.struct(F.col("m").alias("method"), F.col("u").alias("endpoint"), F.col("b").alias("body")).alias("request"))), part).alias("r"), "seq").select("r.*", "seq")
    assert sorted((r.raw["method"], r.seq) for r in records.crawl_assets(made).collect()) == [("GET", 4), ("POST", 1), ("POST", 2)]


def _odd_titles(spark, path):
    titles = ["a &quot;b", "x&amp", "&amp;lt; &lt;b&gt; &amp;", "&nbsp;y  z", "&#65;", "plain"]
    spark.createDataFrame([(i, f"http://h{i}.example.com/", f"<html><head><title>{t}</title></head><body>&quot;<a href=\"/p\">p</a></body></html>") for i, t in enumerate(titles)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")


@pytest.mark.parametrize("name", ["x21_titles", "x9_x10_x21_pages"])
def test_titles_with_other_escapes(spark, tmp_path, name):
    """of a title only the three escapes of markup are undone, as the SQL has it."""
    import duckdb

    from tests.oracle import difference, views

    _odd_titles(spark, tmp_path)
    con = duckdb.connect()
    views(con, str(tmp_path))
    assert difference(plans.queries()[name](spark, str(tmp_path)), con, plans.oracle_sql()[name]) == ""


def test_a_cursor_reads_a_row_group_in_pieces(spark, tmp_path):
    """F8: a slice never holds a whole row group."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from quarrylight.streaming import cursor

    n = 300_000
    pq.write_table(pa.table({"event_id": list(range(n)), "event_type": ["x"] * n}), str(tmp_path / "log.parquet"), row_group_size=n)
    reader = cursor._CursorReader(str(tmp_path), "event_id", -1, 2, ["event_type", "event_id"])
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    batches = [b for p in parts for b in reader.read(p)]
    assert max(b.num_rows for b in batches) <= cursor.BATCH and sum(b.num_rows for b in batches) == n
    assert batches[0].schema.names == ["event_type", "event_id"]


def test_alternatives_of_patterns_are_tried_once():
    """what a pattern offers beside an alternative that others share does not make it one more expression to try."""
    from quarrylight.functions import rules

    rows = [(f"p{n % 3}", "body", "", rf"(?:m|track\({n}\))(?:[.,]|</)") for n in range(300)]
    p = rules.Patterns(rows)
    assert len(p._candidates("body", "an m; track(7)")) <= 2
    assert p.products({}, "an m; track(7).", "") == ["p1"] and p.products({}, "m.", "") == ["p0", "p1", "p2"] and p.products({}, "m;", "") == []


@pytest.mark.parametrize("pattern", [r"(?:a|b)(?:c|d)", r"(a|b)\1", r"a|bc", r"x(?:a|b)", r"(?:a|(?i:b))c", r"(?:a|b)*c", r"[(](?:a|b)", r"(?:|b)c", r"(?i)(?:a|b)c", r"(?:a\)|b)c", r"(?:[)|]|b)c", r"(?:a|b)+?c", r"(?:a|b){2}c", r"(?:a#|b)c"])
def test_alternatives_hold_where_their_pattern_does(pattern):
    import itertools
    import re

    from quarrylight.functions import literals

    for n in range(4):
        for text in map("".join, itertools.product("abcdx(|)", repeat=n)):
            assert any(re.search(p, text, re.I | re.S) for p in literals.alternatives(pattern)) == bool(re.search(pattern, text, re.I | re.S))


def test_quick_patterns_find_what_their_rules_name(spark):
    """and the hint holds wherever the rule does."""
    from pyspark.sql import functions as F

    from quarrylight.functions import text

    assert {r.label for r in text.PII_RULES if r.quick} == {"vehicle_plate_cn", "passport_cn"}
    rows = ["京A12345", "x 使a1234学 领Z99999港", "粤b1234", "中A12345", "WeChat: abcdef", "微信：abcdef wx-id=abcdef WX_ID = q12345", "wexid: abcdef", "E12345678 gabcdefgh ıG1234567K pſ1234567", "épassports9"]
    df = spark.createDataFrame([(x,) for x in rows], "t string")
    for r in text.PII_RULES:
        full = F.regexp_extract_all("t", F.lit(r.pattern), F.lit(0))
        quick = F.regexp_extract_all("t", F.lit(r.quick or r.pattern), F.lit(0))
        assert df.where((full != quick) | (F.size(full) > 0) & ~F.col("t").rlike(r.hint)).count() == 0, r.label


def test_pages_are_dealt_before_they_become_responses(spark, sf):
    """pages of one row group are not one task."""
    from quarrylight.plans import sources

    assert sources.landed(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
