"""Landed responses of data sources as assets.

A landed row is (source, target, body, seq): what was asked for, and the response as text. A connector says where in the body the
rows are and which path each column has; everything else is the same for all. Nothing here calls a source.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.model import as_assets
from quarrylight.operators.normalize import normalized


@dataclass(frozen=True)
class Connector:
    """``rows``: path of the array in the body ('' for the body itself, an object is one row).

    ``columns`` and ``raw``: path in a row, ``a|b`` for the first that is there, ``$`` for the row itself, ``@`` for the target,
    ``^path`` for a path from the body's root. ``many``: a path in a row whose elements are rows of their own (``$``
    then is the element, other paths still start at the row). ``form``: json, ndjson (a line a body), lines (plain
    lines, but for comments), csv (``host,ip`` lines), table (an array of arrays, the first with names), html (the cells of
    table rows). ``refuse``: a part of the body that means an error. ``dynamic``: a path whose value is one more tag.
    ``named``: only rows whose text holds the target.
    """

    name: str
    accepts: str
    cap: int | None
    rows: str = ""
    columns: dict[str, str] = field(default_factory=dict)
    raw: dict[str, str] = field(default_factory=dict)
    tags: str = ""
    form: str = "json"
    many: str = ""
    refuse: str = ""
    dynamic: str = ""
    named: bool = False


_HOST = {"host": "$", "domain": "$"}


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


# The sources' field names, caps and tags.
CONNECTORS = {
    c.name: c
    for c in (
        Connector("fofa", "domain,ip,keyword,company", 5000, "results", {"host": "0", "ip": "1", "port": "2", "title": "3", "domain": "4"}, {"country": "5", "as_org": "6", "server": "7", "protocol": "8"}, "engine,fofa", refuse='"error":true'),
        Connector("hunter", "domain,ip,keyword,company", 5000, "data.arr", {"ip": "ip", "port": "port", "host": "host", "title": "web.title", "server": "web.server", "country": "location.country_cn", "city": "location.city_cn", "protocol": "protocol"}, {"protocol": "protocol", "title": "web.title"}, "engine,hunter"),
        Connector("quake", "domain,ip,keyword,company", 5000, "data", {"ip": "ip", "port": "port|service.port", "host": "service.name", "title": "service.title"}, {"country": "location.country_cn", "province": "location.province_cn"}, "engine,quake"),
        Connector("shodan", "domain,ip,keyword,company", 5000, "matches", {"ip": "ip_str", "port": "port", "host": "hostnames.0", "title": "title"}, {"product": "product", "country": "location.country_name", "os": "os"}, "engine,shodan"),
        Connector("zoomeye", "domain,ip,keyword,company", 5000, "matches", {"ip": "ip", "port": "portinfo.port", "host": "domains.0", "title": "geoinfo.title", "service": "portinfo.service"}, {"country": "geoinfo.country.names.en", "city": "geoinfo.city.names.en"}, "engine,zoomeye"),
        Connector("abuseipdb", "ip", None, "data", {"ip": "@"}, {"score": "abuseConfidenceScore", "country": "countryCode", "isp": "isp"}, "malicious,abuseipdb"),
        Connector("bgp_he", "asn,ip,company", 500, "", {"title": "$"}, {"cidr": "$"}, "bgp,he,cidr", "lines"),
        Connector("binaryedge", "domain,ip,keyword", 100, "events", {"ip": "target.ip", "port": "target.port", "title": "target.title", "country": "target.location.country", "city": "target.location.city", "host": "@"}, {"protocol": "target.protocol"}, "binaryedge,asset"),
        Connector("censys", "domain,ip", 100, "result.hits", {"domain": "$", "cert_issuer": "issuer_dn", "cert_subject": "subject_dn"}, {"fingerprint": "fingerprint_sha256", "issuer_dn": "issuer_dn", "subject_dn": "subject_dn", "valid_from": "validity.start", "valid_to": "validity.end"}, "tls,cert,censys", many="names"),
        Connector("certspotter", "domain", 500, "", _HOST, {}, "ctlog,certspotter", many="dns_names"),
        Connector("chaos", "domain", 200, "subdomains", {"host": "$"}, {"subdomain": "$"}, "chaos,subdomain"),
        Connector("chinaz", "domain", 200, "", _HOST, {}, "subdomain,chinaz", "lines"),
        Connector("ct_log", "domain", 500, "", _HOST, {"issuer": "issuer_name", "not_before": "not_before", "not_after": "not_after"}, "ctlog,cert", many="name_value"),
        Connector("cve_match", "service,product,version", 50, "data|vulnerabilities", {"title": "id|cve.id"}, {"cve_id": "id|cve.id", "summary": "summary|cve.descriptions.0.value", "published": "Published|cve.published", "cvss": "cvss|cve.metrics.cvssV3.baseScore"}, "cve,vulnerability"),
        Connector("daydaymap", "domain,ip", 500, "data.list", {"ip": "ip", "port": "port", "host": "host|domain", "domain": "domain", "url": "url|link", "server": "server|header_hash", "province": "region|province", "org": "isp|organization", "update_time": "update_time|timestamp", "protocol": "protocol", "title": "title"}, {}, "daydaymap"),
        Connector("dnsdumpster", "domain", 100, "a|ns|mx", {"host": "host|ips.0.ip", "ip": "ips.0.ip", "domain": "@"}, {"ip": "ips.0.ip"}, "dnsdumpster"),
        Connector("greynoise", "ip", 50, "", {"ip": "@"}, _same("classification", "confidence", "last_seen", "actor"), "malicious,ip,greynoise"),
        Connector("hackertarget", "domain,ip", 100, "", {"host": "0", "domain": "0", "ip": "1"}, {}, "subdomain,hackertarget", "csv", refuse="API count exceeded"),
        Connector("internetdb", "ip", None, "", {"ip": "@", "port": "$"}, _same("hostnames", "vulns", "cpes"), "internetdb,shodan", many="ports"),
        Connector("ipinfo", "ip", None, "", {"ip": "@", "country": "country", "city": "city", "org": "org"}, _same("country", "city", "region", "org", "postal"), "ipinfo,geo"),
        Connector("leakix", "domain,keyword", 50, "Services", {"ip": "ip", "port": "port", "host": "@", "domain": "@"}, {"software": "software.name", "summary": "summary"}, "leakix,service"),
        Connector("netlas", "domain,ip", 200, "items", {"ip": "data.ip", "port": "data.port", "host": "data.host", "title": "data.http.title"}, {}, "netlas,asset"),
        Connector("onyphe", "domain,ip", 500, "results", {"ip": "ip", "port": "port", "host": "hostname|hostname.0|domain", "domain": "domain|domain.0", "protocol": "protocol|scheme", "server": "headers.server|header.server|headers.Server", "org": "organization|subnet", "title": "title", "country": "country", "city": "city", "asn": "asn"}, {}, "onyphe"),
        Connector("otx", "domain,ip", 500, "passive_dns", {"host": "hostname", "domain": "hostname", "ip": "address"}, _same("first", "last"), "otx,pdns"),
        Connector("rapiddns", "domain", 500, "", _HOST, {}, "subdomain,rapiddns", "lines"),
        Connector("securitytrails", "domain", 2000, "current_dns.a.values|records", {"ip": "ip|values.0.ip", "domain": "@", "host": "@"}, _same("first_seen", "last_seen"), "securitytrails"),
        Connector("threatminer", "domain,ip", 500, "results", _HOST, {}, "threatminer,pdns"),
        Connector("urlscan", "domain,url,ip", 100, "results", {"url": "page.url", "ip": "page.ip", "domain": "page.domain", "host": "page.domain", "title": "page.title"}, {"title": "page.title", "country": "page.country"}, "urlscan,scan"),
        Connector("virustotal", "ip,domain,hash,url", 50, "", {"host": "@"}, _same("positives", "total", "scan_date", "permalink"), "malicious,virustotal"),
        Connector("whois_reverse", "domain,company", 1000, "domainsList", _HOST, {}, "reverse-whois"),
        Connector("commoncrawl", "domain", 500, "", {"url": "url", "title": "url"}, {}, "commoncrawl,archive", "ndjson"),
        Connector("dnslytics", "ip,domain", None, "", {"ip": "@"}, _same("asn", "country", "isp"), "dnslytics,ip"),
        Connector("viewdns", "ip,domain", 500, "response.domains", {"host": "name", "domain": "name"}, {}, "viewdns,reverse"),
        Connector("robtex", "domain,ip", 200, "", {"host": "rrname", "domain": "rrname", "ip": "rrdata"}, {}, "robtex,pdns", "ndjson"),
        Connector("ripestat", "ip,asn", None, "data", {"ip": "@"}, _same("asns", "prefix"), "ripestat,ip"),
        Connector("rdap", "domain,ip,asn", None, "", {"domain": "@", "host": "@"}, _same("handle", "status", "nameservers"), "rdap,whois"),
        Connector("publicwww", "keyword", 500, "", {"url": "$", "title": "$"}, {}, "publicwww,code", "lines"),
        Connector("pulsedive", "ip,domain", None, "", {"host": "@"}, {"indicator": "@", "risk": "risk", "threats": "threats"}, "pulsedive", dynamic="risk"),
        Connector("pdns_circl", "domain,ip", 500, "", {"host": "rrname", "domain": "rrname"}, {"rdata": "rdata"}, "circl,pdns", "ndjson"),
        Connector("pdns_mnemonic", "domain,ip", 500, "data", {"host": "query", "domain": "query"}, {"answer": "answer"}, "mnemonic,pdns"),
        Connector("hunt_io", "ip,domain", None, "", {"ip": "@"}, {"classifications": "classifications"}, "hunt_io,malicious"),
        Connector("greynoise_community", "ip", None, "", {"ip": "@"}, _same("classification", "name"), "greynoise", dynamic="classification"),
        Connector("github_commits", "keyword,domain", 50, "items", {"url": "html_url", "title": "repository.full_name"}, {"repo": "repository.full_name", "message": "commit.message"}, "github,commit"),
        Connector("driftnet", "domain,ip", 200, "results", {"host": "host", "domain": "host", "ip": "ip"}, {}, "driftnet,scan"),
        Connector("validin", "domain,ip", 200, "records", {"host": "value", "domain": "value"}, {}, "validin,pdns"),
        Connector("searchengine", "keyword", 50, "", {"url": "$", "title": "$"}, {}, "search,ddg", "lines"),
        Connector("shodan_enrich", "ip", None, "data", {"ip": "@", "port": "port", "title": "http.title", "service": "product"}, {}, "shodan,enrich"),
        Connector("opencorporates", "company", 50, "results.companies", {"org": "company.name", "title": "company.name"}, {"name": "company.name", "number": "company.company_number", "jurisdiction": "company.jurisdiction_code"}, "company,opencorporates"),
        Connector("wayback", "domain", 5000, "", {"url": "original"}, {"timestamp": "timestamp", "mimetype": "mimetype", "statuscode": "statuscode"}, "", "table"),
        Connector("supply_github_org", "domain,company,keyword", None, "", {"url": "html_url", "title": "description", "org": "name|full_name", "host": "homepage|blog", "update_time": "updated_at"}, {"name": "full_name", "language": "language"}, "GitHub-Org"),
        Connector("app_market_search", "domain,company", 50, "RelatedTopics", {"url": "FirstURL", "title": "Text"}, {"snippet": "Text"}, "app,market"),
        Connector("gitee_code", "domain,company,keyword", 50, "", {"url": "$", "title": "$"}, {}, "gitee,code", "lines"),
        Connector("github_code", "domain,company,keyword", 50, "items", {"url": "html_url", "title": "path"}, {"repo": "repository.full_name", "path": "path", "sha": "sha"}, "code,github"),
        Connector("bgpview", "ip,asn,domain", 50, "data.asns|data.prefixes", {"asn": "asn", "org": "name", "country": "country_code"}, {"rir": "rir", "allocated": "allocated", "prefix": "prefix"}, "bgp,asn"),
        Connector("asn_recon", "domain,company,ip,asn", 200, "results", {"host": "host|0", "ip": "ip|1", "port": "port|2", "title": "title|3"}, {}, "asn,passive,fofa"),
        Connector("fullhunt", "domain,ip,keyword", 100, "hosts|data", {"host": "host", "ip": "ip", "port": "port", "title": "title", "service": "service", "country": "country", "city": "city"}, {}, "fullhunt,asset"),
        Connector("maltiverse", "ip,domain,hash", 50, "", {"host": "@"}, _same("malicious", "confidence", "description"), "malicious,maltiverse"),
        Connector("zerozone", "domain,ip,keyword,company", 5000, "data|data.list", {"ip": "msg.ip|ip", "domain": "domain|root_domain", "url": "url", "org": "company|group", "icp": "beian|icp", "update_time": "timestamp"}, {}, "engine,zerozone"),
        Connector("abusech", "ip,domain", 50, "", {"ip": "$", "title": "$"}, {}, "malware,c2,feodo", "lines", named=True),
        Connector("abusech_urlhaus", "ip,domain", 50, "", {"url": "$", "title": "$"}, {}, "malware,urlhaus", "lines", named=True),
        Connector("bdziyi_fofa", "domain", 500, "results", {"url": "0", "host": "0", "ip": "1", "title": "2", "port": "3", "protocol": "5"}, {}, "bdziyi,fofa-proxy", refuse='"error":true'),
        Connector("bdziyi_icp", "domain,company,keyword", 500, "result", {"domain": "domain|@", "host": "domain|@", "org": "unitName", "icp": "serviceLicence|mainLicence", "update_time": "updateRecordTime", "title": "unitName"}, {"nature": "natureName", "content": "contentTypeName"}, "bdziyi,bdziyi-icp"),
        Connector("bdziyi_ze", "domain", 500, "data|results", {"ip": "ip", "port": "port", "host": "domain|hostname", "domain": "domain", "title": "title.0|title", "isp": "isp.name|organization.name", "country": "country.name|country", "province": "province.name|province", "city": "city.name|city", "server": "header.server.name|server", "protocol": "service|protocol"}, {"asn": "asn"}, "bdziyi,ze-proxy"),
        Connector("beianx", "domain,company,keyword", None, "", {"org": "1", "icp": "3", "title": "4", "domain": "5", "host": "5", "update_time": "6"}, {}, "icp,beianx", "html"),
        Connector("company_structure_api", "company", 500, "enterprise_info|investment_info|icp_info|app_info|wechat_info", {"host": "domain|website", "domain": "domain|website", "title": "name|domain"}, {"name": "name", "website": "website", "share_ratio": "share_ratio", "icp_num": "icp_num", "platform": "platform", "type": "type"}, "company"),
        Connector("zerozone_extra", "domain,company", 100, "data|data.list", {"host": "domain", "domain": "domain|root_domain", "ip": "msg.ip", "url": "url", "title": "title|name", "org": "company|owner", "icp": "icp", "update_time": "timestamp_update|timestamp"}, {}, "zerozone"),
    )
}
for _alias, _name in (("shodan_engine", "shodan"), ("zoomeye_engine", "zoomeye")):
    CONNECTORS[_alias] = CONNECTORS[_name]

#: Sources of the inventory that are not read: lookups of persons and of credentials; and two without a fixed response format.
NOT_READ = (
    "hibp", "emailrep", "hunter_io", "hunter_verify", "hudsonrock", "intelx", "proxynova_combo", "psbdmp", "skymem", "pgpkeys", "employee_dork", "secret_scan", "ci_secret_search",
    "netdisk_search", "supply_vendor",
)
#: Sources that analyse texts or pages at hand; their work is in the functions named.
BY_FUNCTION = {
    "pii_scan": "text.scan", "ipv6_pii_scan": "text.scan_ipv6", "email_regex": "text.scan", "js_endpoints": "text.script_endpoints", "source_map_leak": "text.source_map_files", "wayback_params": "report.parameters",
    "supply_pivots": "joins.sharing", "supply_auto": "joins.sharing", "path_pivot": "report.sensitive_paths", "cloud_bucket": "classify.base_name",
}


def _steps(path: str) -> str:
    """A path with dots as a variant path; numbers are array places. ``@``, ``$`` and ``^`` stay marks of their own."""
    if path in ("@", "$"):
        return path
    root = "^" if path.startswith("^") else ""
    return root + "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.removeprefix("^").split(".") if p)


def _config(name: str, c: Connector) -> dict:
    specs = lambda d: [{"name": k, "paths": [_steps(p) for p in v.split("|")]} for k, v in d.items()]
    return {
        "source": name, "form": c.form, "rows": [_steps(p) for p in c.rows.split("|")], "columns": specs(c.columns), "raw": specs(c.raw), "tags": [t for t in c.tags.split(",") if t],
        "many": _steps(c.many) if c.many else None, "refuse": c.refuse or None, "dynamic": [_steps(c.dynamic)] if c.dynamic else [], "cap": c.cap, "named": c.named,
    }


_SPECS = "array<struct<name:string,paths:array<string>>>"
_CONFIG = f"array<struct<source:string,form:string,rows:array<string>,columns:{_SPECS},raw:{_SPECS},tags:array<string>,many:string,refuse:string,dynamic:array<string>,cap:int,named:boolean>>"


def _get(v: Column, path: Column, kind: str = "variant") -> Column:
    return F.call_function("try_variant_get", v, path, F.lit(kind))


def _text(v: Column) -> Column:
    """A variant as text: strings bare, others as JSON."""
    return F.nullif(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)), F.lit(""))


def _texts(values: Column) -> Column:
    """Texts as an array of variants."""
    return F.try_variant_get(F.try_parse_json(F.to_json(values)), "$", "array<variant>")


def _first(paths: Column) -> Column:
    """What the first of ``paths`` that leads somewhere gives."""

    def of(p: Column) -> Column:
        there = _get(F.when(p.startswith("^"), F.col("_root")).otherwise(F.col("_row")), F.ltrim(p, F.lit("^")))
        return F.when(p == "@", F.col("target")).when(p == "$", _text(F.col("_element"))).otherwise(_text(there))

    return F.get(F.filter(F.transform(paths, of), lambda x: x.isNotNull()), F.lit(0))


def _rows() -> Column:
    """array<variant>: the rows of a body, by the form of its source."""
    lines = F.filter(F.split("body", r"\r?\n"), lambda x: F.trim(x) != "")
    plain = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: ~x.startswith("#"))
    cells = F.try_variant_get(F.try_parse_json("body"), "$", "array<array<string>>")
    named = F.transform(F.filter(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), lambda r: F.size(r) == F.size(F.get(cells, 0))), lambda r: F.try_parse_json(F.to_json(F.map_from_arrays(F.get(cells, 0), r))))
    tidy = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " "))
    table = F.transform(F.slice(F.split("body", r"(?i)<tr[\s>]"), 2, 1 << 30), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), tidy))
    whole = lambda p: _get(F.col("_root"), p)
    arrays = F.transform("rows", lambda p: F.coalesce(_get(F.col("_root"), p, "array<variant>"), F.when(whole(p).isNotNull() & F.schema_of_variant(whole(p)).startswith("OBJECT"), F.array(whole(p))), F.array().cast("array<variant>")))
    return (
        F.when(F.col("form") == "json", F.flatten(arrays))
        .when(F.col("form") == "ndjson", F.transform(lines, lambda x: F.try_parse_json(x)))
        .when(F.col("form") == "lines", _texts(plain))
        .when(F.col("form") == "csv", F.transform(lines, lambda x: F.try_parse_json(F.to_json(F.transform(F.split(x, ","), lambda y: F.trim(y))))))
        .when(F.col("form") == "html", F.transform(F.filter(table, lambda r: F.size(r) > 5), lambda r: F.try_parse_json(F.to_json(r))))
        .otherwise(named)
    )


def ingest(landed: DataFrame, names: Iterable[str] = ()) -> DataFrame:
    """All connectors' rows of ``landed`` (source, target, body, seq) as assets, in one pass over it.

    What to read where comes from a small table, one row a source, so a further source costs no further scan. A source
    with a cap gives at most so many rows for each target, in order. Rows of sources not in ``names`` (if there are
    any) or unknown ones give nothing.
    """
    return _ingest(landed, {n: CONNECTORS[n] for n in (names or CONNECTORS)})


def project(landed: DataFrame, c: Connector) -> DataFrame:
    """One connector's rows of ``landed`` (target, body, seq)."""
    return _ingest(landed.withColumn("source", F.lit(c.name)), {c.name: c})


def _ingest(landed: DataFrame, connectors: dict[str, Connector]) -> DataFrame:
    spark = landed.sparkSession
    known = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([_config(n, c) for n, c in connectors.items()])), _CONFIG)))
    df = landed.select("source", "target", "body", "seq").join(F.broadcast(known), "source")  # a row for each connector
    df = df.where(~F.coalesce(F.contains("body", "refuse"), F.lit(False)))
    df = df.withColumn("_root", F.when(F.col("form") == "json", F.try_parse_json("body")))
    df = df.select("*", F.posexplode(_rows()).alias("_at", "_row")).drop("body")
    # some pack several values into one text, a line each
    inner = _get(F.col("_row"), F.col("many"))
    elements = F.coalesce(F.try_variant_get(inner, "$", "array<variant>"), _texts(F.split(F.try_variant_get(inner, "$", "string"), "\n")), F.array().cast("array<variant>"))
    df = df.select("*", F.posexplode(F.when(F.col("many").isNotNull(), elements).otherwise(F.array("_row"))).alias("_sub", "_element"))
    df = df.where(~F.col("named") | F.coalesce(F.contains(_text(F.col("_element")), F.col("target")), F.lit(False)))
    of = F.map_from_entries(F.transform("columns", lambda c: F.struct(c["name"].alias("key"), _first(c["paths"]).alias("value"))))
    raw = F.filter(F.transform("raw", lambda c: F.struct(c["name"].alias("key"), _first(c["paths"]).alias("value"))), lambda e: e["value"].isNotNull())
    raw = F.when(F.size("raw") > 0, F.map_from_entries(raw))
    df = df.select("source", "target", "seq", "_at", "_sub", "cap", of.alias("_of"), raw.alias("raw"), F.array_compact(F.concat("tags", F.array(_first(F.col("dynamic"))))).alias("tags"))
    df = df.where(F.exists(F.map_values("_of"), lambda v: v.isNotNull()))
    # rows of a source without a cap are dealt by their response: no target of theirs is one task
    place = Window.partitionBy("source", "target", F.when(F.col("cap").isNull(), F.col("seq"))).orderBy("seq", "_at", "_sub")
    if any(c.cap for c in connectors.values()):
        df = df.withColumn("_place", F.row_number().over(place)).where(F.col("cap").isNull() | (F.col("_place") <= F.col("cap")))
    columns = sorted({k for c in connectors.values() for k in c.columns})
    values = [F.col("_of")[k].try_cast("int").alias(k) if k == "port" else F.col("_of")[k].alias(k) for k in columns]
    return normalized(as_assets(df.select("seq", "source", "raw", "tags", *values)))


def read_landed(spark, path: str, source: str | None = None) -> DataFrame:
    """Responses stored as JSON lines (source, target, body, seq)."""
    df = spark.read.schema("source string, target string, body string, seq long").json(path)
    return df.where(F.col("source") == source) if source else df
