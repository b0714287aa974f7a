"""Host and URL normalisation, the smart key, column-ordered projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.model import EXPORT, LISTS


def clean_host(c: Column) -> Column:
    """Without scheme, cut at the first ``/``, ``?`` or ``#``, lower case."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(F.trim(c), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://", ""), r"[/?#].*$", "")), F.lit(""))


def normalized(df: DataFrame) -> DataFrame:
    """Hosts and domains cleaned; a host with exactly one colon and no port known gives its port up."""
    out = df.withColumns({"host": clean_host(F.col("host")), "domain": clean_host(F.col("domain"))})
    parts = F.split("host", ":")
    port = F.get(parts, F.lit(1)).try_cast("int")
    split = (F.size(parts) == 2) & F.col("port").isNull() & port.isNotNull() & (port > 0)
    return out.withColumns({"port": F.when(split, port).otherwise(F.col("port")), "host": F.when(split, F.nullif(parts[0], F.lit(""))).otherwise(F.col("host"))})


def promoted(df: DataFrame) -> DataFrame:
    """Facts that some sources leave in ``raw`` only are taken from there."""
    known = {"country": "country", "server": "server", "protocol": "protocol", "title": "title", "org": "as_org", "service": "service"}
    out = {c: F.coalesce(F.col(c), F.nullif(F.try_element_at("raw", F.lit(k)), F.lit(""))) for c, k in known.items()}
    out["port"] = F.coalesce("port", F.nullif(F.try_element_at("raw", F.lit("port")).try_cast("int"), F.lit(0)))
    return df.withColumns(out)


def smart_key() -> Column:
    """Web ports fold to ``host:web``; else ip:port, host:port, host, url, ip; null if there is none of these."""
    h = F.lower(F.coalesce("host", "domain"))
    port = F.col("port").cast("string")
    return (
        F.when(h.isNotNull() & F.col("port").isin(80, 443), F.concat(h, F.lit(":web")))
        .when(F.col("ip").isNotNull() & F.col("port").isNotNull(), F.concat("ip", F.lit(":"), port))
        .when(h.isNotNull() & F.col("port").isNotNull(), F.concat(h, F.lit(":"), port))
        .otherwise(F.coalesce(h, F.lower("url"), F.col("ip")))
    )


def is_ip(c: Column) -> Column:
    """Four dotted numbers up to 255, or a colon and no dot."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|0*[0-9]{1,2})"
    return c.rlike(rf"^{octet}(\.{octet}){{3}}$") | (c.contains(":") & ~c.contains("."))


def flat(columns: tuple[str, ...] = EXPORT, separator: str = ",") -> list[Column]:
    """The columns of an export: lists joined, other values as they are."""
    return [F.array_join(c, separator).alias(c) if c in LISTS else F.col(c) for c in columns]


def compact_json(df: DataFrame) -> Column:
    """A row as JSON without its missing values; lists joined."""
    return F.to_json(F.struct(*flat(tuple(c for c in EXPORT if c in df.columns))))


def without_query(url: Column) -> Column:
    """The key under which URLs that differ by query or fragment are the same."""
    return F.regexp_replace(url, r"[?#].*$", "")


def url_host(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
