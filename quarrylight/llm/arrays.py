"""Array expressions that the operators without Python share; all take time in proportion to the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.llm.shared import let

_CHUNK = 256


def _running(values: Column) -> Column:
    """Sums of what stands before each value. Appending copies, so it is for short arrays."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out")), lambda acc: acc["out"])


def prefix_sums(values: Column) -> Column:
    """For an array of longs, what the values before each one sum to; in chunks, so that long arrays stay linear."""

    def of(v: Column) -> Column:
        n = F.ceil(F.size(v) / F.lit(_CHUNK)).cast("int")
        some = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
        chunks = F.transform(some, lambda i: F.slice(v, i * _CHUNK + 1, F.lit(_CHUNK)))

        def glue(parts: Column) -> Column:
            sums = F.transform(parts, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
            return F.flatten(F.zip_with(parts, _running(sums), lambda c, before: F.transform(_running(c), lambda y: y + before)))

        return let(chunks, glue)

    return let(values, of)


def run_starts(ordered: Column) -> Column:
    """0-based places of a sorted array's first elements of each run of equal ones."""
    places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))


def match_spans(text: Column, pattern: str, with_group: int | None = None) -> Column:
    """array<struct<start, end, group>> of the leftmost matches of ``pattern`` that don't overlap, in code points.

    Matches and what stands between them have the same places in two arrays, so lengths give the spans. ``group`` is
    the text of ``with_group``, else of the match. The pattern must not match an empty text.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = found if with_group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(with_group))

    def spans(matches: Column) -> Column:
        def of(gaps: Column) -> Column:
            lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: (F.length(g) + F.length(m)).cast("long"))
            pairs = F.zip_with(prefix_sums(lengths), F.slice(gaps, F.lit(1), F.size(matches)), lambda before, g: before + F.length(g))
            rows = F.zip_with(pairs, matches, lambda start, m: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("group")))
            if with_group is None:
                return rows
            return F.zip_with(rows, groups, lambda r, g: F.struct(r["start"].alias("start"), r["end"].alias("end"), g.alias("group")))

        return let(F.split(text, pattern, -1), of)

    none = F.array().cast("array<struct<start:bigint,end:bigint,group:string>>")
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(spans(m).cast("array<struct<start:bigint,end:bigint,group:string>>")))
