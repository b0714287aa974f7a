"""The asset relation: one row for each sighting of a host, address, URL or certificate.

Missing values are null (an empty string, port 0 and an empty list are made null on the way in and come back only in
sinks). ``seq`` is the order of arrival; every "first" and "last" below refers to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _L = T.StringType(), T.ArrayType(T.StringType())

#: The relation's columns, in the order of exports.
SCALARS = (
    "ip", "port", "protocol", "domain", "host", "url", "service", "title", "server", "os", "country", "province", "city",
    "asn", "org", "isp", "cert_subject", "cert_issuer", "jarm", "ja3s", "favicon_hash", "icp", "update_time",
)
LISTS = ("products", "cert_domains", "tags")
EXPORT = (
    "ip", "port", "protocol", "domain", "host", "url", "service", "title", "server", "products", "os", "country", "province", "city",
    "asn", "org", "isp", "cert_subject", "cert_issuer", "cert_domains", "jarm", "ja3s", "favicon_hash", "icp", "source", "update_time", "tags",
)

SCHEMA = T.StructType(
    [T.StructField(c, T.IntegerType() if c == "port" else _S) for c in SCALARS]
    + [T.StructField(c, _L) for c in LISTS]
    + [T.StructField("source", _S), T.StructField("raw", T.MapType(_S, _S)), T.StructField("created", T.TimestampType()), T.StructField("seq", T.LongType())]
)
COLUMNS = tuple(SCHEMA.fieldNames())


def as_assets(df: DataFrame) -> DataFrame:
    """``df`` with exactly the relation's columns: others go, absent ones are null, empty values become null."""
    out: list[Column] = []
    for f in SCHEMA.fields:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f.name).cast(f.dataType)
        if isinstance(f.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        elif f.name == "port":
            c = F.nullif(c, F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        out.append(c.alias(f.name))
    return df.select(*out)
