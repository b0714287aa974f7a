"""Relevance, caps, target lists, admission predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.operators.normalize import is_ip, url_host


def relevant(target: str) -> Column:
    """Is an asset about ``target``?

    An address: equal ``ip``. A word without a dot: everything. A domain: host, domain, URL host or a certificate's domain is
    it or below it, or one of their labels (split at ``. - _``) is its first label.
    """
    t = target.strip().lower()
    if not t or "." not in t and ":" not in t:
        return F.lit(True)
    parts = t.split(".")
    if len(parts) == 4 and all(p.isdigit() and int(p) <= 255 for p in parts) or ":" in t and "." not in t:
        return F.coalesce(F.col("ip") == t, F.lit(False))

    def about(name: Column) -> Column:
        h = F.lower(name)
        return (h == t) | h.endswith(f".{t}") | F.array_contains(F.split(h, r"[._\-]"), parts[0])

    own = [F.coalesce(about(c), F.lit(False)) for c in (F.col("host"), F.col("domain"), url_host(F.col("url")))]
    certs = F.coalesce(F.exists("cert_domains", about), F.lit(False))
    return own[0] | own[1] | own[2] | certs


def relevant_to(assets: DataFrame, targets: DataFrame, key: str = "seq", target: str = "target") -> DataFrame:
    """Distinct (key, target) for which :func:`relevant` holds, for any number of targets: equi-joins, no row meets every target.

    A name is written out as itself and what is below each of its dots, and as its labels; targets meet the former, their
    first labels the latter. A target that takes everything has one row, with a null key.
    """
    t = targets.select(F.col(target).alias("target"), F.lower(F.trim(target)).alias("t")).where("t IS NOT NULL").distinct()
    everything = (F.col("t") == "") | ~F.col("t").contains(".") & ~F.col("t").contains(":")
    parts = F.split("t", r"\.")
    quad = (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike(r"^\d+$") & (p.try_cast("int") <= 255))
    kinds = t.withColumn("kind", F.when(everything, "all").when(quad | F.col("t").contains(":") & ~F.col("t").contains("."), "ip").otherwise("name")).withColumn("label", F.get(parts, F.lit(0)))
    none = F.array().cast("array<string>")
    names = F.array_compact(F.array_distinct(F.concat(F.array(*[F.lower(c) for c in (F.col("host"), F.col("domain"), url_host(F.col("url")))]), F.coalesce(F.transform("cert_domains", lambda x: F.lower(x)), none))))
    words = assets.select(key, F.explode(names).alias("h")).distinct()
    # below each dot: a.b.c, b.c, c
    tails = F.transform(F.sequence(F.lit(1), F.size(F.split("h", r"\."))), lambda i: F.call_function("substring_index", F.col("h"), F.lit("."), -i))
    suffixes = words.select(key, F.explode(tails).alias("t")).distinct()
    labels = words.select(key, F.explode(F.split("h", r"[._\-]")).alias("label")).distinct()
    by_name = kinds.where("kind = 'name'")
    found = [
        assets.select(key, F.col("ip").alias("t")).where("t IS NOT NULL").join(kinds.where("kind = 'ip'"), "t").select(key, "target"),
        suffixes.join(by_name.select("t", "target"), "t").select(key, "target"),
        labels.join(by_name.select("label", "target"), "label").select(key, "target"),
    ]
    found.append(kinds.where("kind = 'all'").select(F.lit(None).cast(assets.schema[key].dataType).alias(key), "target"))
    return found[0].union(found[1]).union(found[2]).union(found[3]).distinct()


def capped(df: DataFrame, most: int, group: str = "source", order: Sequence[str] = ("seq",)) -> DataFrame:
    """At most ``most`` rows of each group, the first ones. Spark keeps no more than that for each group and map task (a window group limit)."""
    at = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= most).drop("_at")


def first_rows(df: DataFrame, most: int, order: Sequence[str] = ("seq",)) -> DataFrame:
    return df.orderBy(*order).limit(most)


def target_list(lines: DataFrame, column: str = "line", seq: str = "seq") -> DataFrame:
    """(target, seq): lines split at commas, semicolons and white space, trimmed; each target once, at its first place."""
    parts = lines.select(F.posexplode(F.split(column, r"[,;\s]+")).alias("at", "target"), F.col(seq))
    first = parts.where("target <> ''").groupBy("target").agg(F.min(F.struct(F.col(seq).alias("line"), "at")).alias("first"))
    return first.select("target", F.col("first.line").alias("line"), F.col("first.at").alias("at"))


def labelled(column: str, enable: Sequence[str] = (), disable: Sequence[str] = ()) -> Column:
    """In the first list, if there is one, and not in the second."""
    keep = F.col(column).isin(*enable) if enable else F.lit(True)
    return keep & ~F.col(column).isin(*disable) if disable else keep


def tagged(*words: str) -> Column:
    """One of the tags contains one of ``words``."""
    joined = F.coalesce(F.array_join("tags", ","), F.lit(""))
    out = F.lit(False)
    for w in words:
        out = out | joined.contains(w)
    return out


def accepted(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, target): targets with a kind (array ``kinds``) that the source takes (array ``accepts``)."""
    kinds = targets.select("target", F.explode("kinds").alias("kind"))
    wants = sources.select("source", F.explode("accepts").alias("kind"))
    return kinds.join(wants, "kind").select("source", "target").distinct()


def admitted(url: Column, scope: str | None = None, allow_ext: Sequence[str] = (), deny_ext: Sequence[str] = (), allow: str | None = None, exclude: str | None = None, root_scope: bool = False) -> Column:
    """A recorded URL passes if its extension, patterns and host are in scope."""
    ext = F.lower(F.regexp_extract(url, r"\.([A-Za-z0-9]{1,8})(?:[?#].*)?$", 1))
    ok = F.lit(True)
    if allow_ext:
        ok = ok & ext.isin("", *[e.lower().lstrip(".") for e in allow_ext])
    if deny_ext:
        ok = ok & ~ext.isin(*[e.lower().lstrip(".") for e in deny_ext])
    if allow:
        ok = ok & url.rlike(allow)
    if exclude:
        ok = ok & ~url.rlike(exclude)
    if scope:
        host = url_host(url)
        inside = (host == scope.lower()) | host.endswith(f".{scope.lower()}") if root_scope else host == scope.lower()
        ok = ok & F.coalesce(inside, F.lit(False))
    return ok


def ip_literals(column: str) -> Column:
    return is_ip(F.col(column))
