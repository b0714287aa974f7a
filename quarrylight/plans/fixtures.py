"""An asset table made of the fixture's pages, the same in Spark and in DuckDB.

Scalars are one text for both. Lists and maps differ in their constructors only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylight.model import as_assets

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_PROTOCOL = "regexp_extract(url, '^([a-z]+)://', 1)"


def _pick(n: int, values: list[str | None], by: str = "page_id") -> str:
    """One of ``values`` (SQL) by ``by % n``; the rest is null."""
    return f"CASE {by} % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values) if v is not None) + " END"


SOURCES = ["fofa", "hunter", "quake", "ctlog", "wayback", "hibp", "zerozone-app", "fofa-supply", "github_org", "certspotter", "email_regex", "fofa+hunter"]
SCALARS = {
    "seq": "page_id",
    "ip": "CASE WHEN page_id % 33 = 0 THEN NULL ELSE concat('10.0.', CAST(page_id % 4 AS STRING), '.', CAST(page_id % 50 AS STRING)) END",
    "port": f"CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 8080 ELSE CASE WHEN {_PROTOCOL} = 'https' THEN 443 ELSE 80 END END",
    "protocol": _PROTOCOL,
    "domain": f"CASE WHEN page_id % 13 = 0 THEN NULL ELSE {_HOST} END",
    "host": f"CASE WHEN page_id % 11 = 0 THEN NULL ELSE {_HOST} END",
    "url": "CASE WHEN page_id % 22 = 0 THEN NULL ELSE url END",
    "service": _pick(6, ["'http'", "'app'", None, "'email'", "'ssh'", "'http'"]),
    "title": f"CASE WHEN page_id % 12 = 10 THEN concat('write to User', CAST(page_id % 7 AS STRING), '@', {_HOST}) ELSE trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) END",
    "server": _pick(4, ["'nginx/1.20'", "'Apache'", None, "'cloudflare'"]),
    "os": _pick(3, ["'linux'", None, "'windows'"]),
    "country": _pick(5, ["'US'", "'DE'", "'CN'", "'FR'", None]),
    "city": _pick(7, ["'Berlin'", "'Paris'", None, "'Austin'", "'Berlin'", "'Lyon'", "'Bonn'"]),
    "asn": _pick(3, ["'AS100'", "'AS200'", None]),
    "org": _pick(8, ["'Acme Inc.'", "'Globex'", None, "'Initech'", "'Acme Inc.'", "'Umbrella Cloudflare'", None, "'Hooli'"]),
    "isp": _pick(4, ["'isp-a'", None, "'isp-b'", "'akamai'"]),
    "cert_subject": _pick(6, ["'CN=a,O=Acme Inc.'", "'CN=b,O=Globex'", None, "'CN=c'", None, "'CN=a,O=Acme Inc.'"]),
    "cert_issuer": _pick(4, ["'R3'", "'DigiCert Inc'", None, "'R3'"]),
    "favicon_hash": _pick(5, ["'81586312'", None, "'0'", "'-1085141318'", None]),
    "icp": _pick(6, [None, "'ICP12345'", None, None, "'ICP777'", None]),
    "source": _pick(12, [f"'{s}'" for s in SOURCES]),
    "update_time": "concat('2024-01-', lpad(CAST(1 + page_id % 28 AS STRING), 2, '0'))",
}
LISTS = {
    "products": [["nginx", "php"], ["WordPress"], None, ["nginx"], ["Grafana", "Go"]],
    "cert_domains": [["*.example.com", "example.com"], None, ["www.example.org"], None],
    "tags": [["CDN", "edge"], ["high-value", "admin", "template:t1"], ["敏感端口:SSH"], ["登录入口", "APP"], None, ["high-value", "api"], ["Android", "后台路径"]],
}


def _list_sql(name: str, make: str) -> str:
    values = LISTS[name]
    return _pick(len(values), [None if v is None else f"{make}({', '.join(repr(x) for x in v)})" for v in values])


def _columns(engine: str) -> list[str]:
    make = "array" if engine == "spark" else "list_value"
    raw = "map('k', CAST(page_id % 9 AS STRING), 'n', CAST(page_id % 2 AS STRING))" if engine == "spark" else "MAP {'k': CAST(page_id % 9 AS STRING), 'n': CAST(page_id % 2 AS STRING)}"
    out = [f"{e} AS {c}" for c, e in SCALARS.items()] + [f"{_list_sql(c, make)} AS {c}" for c in LISTS]
    return [*out, f"CASE WHEN page_id % 3 = 0 THEN {raw} END AS raw"]


#: A common table expression ``a``; further ones may follow after a comma.
ASSETS_SQL = f"WITH a AS (SELECT {', '.join(_columns('duckdb'))} FROM pages)"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_assets(spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*_columns("spark")))
