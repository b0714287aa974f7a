"""Report sheets: counts, roll-ups and filtered detail over assets.

Each sheet is one lazy DataFrame with every row in it; limits are kept only where the sheet is a top list. Orders are part
of a sheet's meaning, so they are total.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylight.functions.classify import root_domain
from quarrylight.model import LISTS
from quarrylight.operators.filters import tagged
from quarrylight.operators.normalize import flat, url_path, url_query

_EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
# Which sources feed a sheet.
EMAIL_SOURCES = r"email|^hibp$|^psbdmp$|^intelx$|github_commits|hudsonrock|proxynova|breachdirectory"
APP_SOURCES = r"zerozone-(?:app|apk)"
SUPPLY_SOURCES = r"fofa-supply|fofa-customer|github_org|zerozone-(?:org|member|branch|code)"
LEAK_SOURCES = r"hibp|intelx_leak|intelx|psbdmp|leakix|hunter-verify"
CT_SOURCES = r"^(?:ctlog|certspotter|crt\.sh|chaos|rapiddns|dnsdumpster)"
SUPPLY_BUCKETS = (("fofa-supply", "pivot"), ("fofa-customer", "customer"), ("github_org", "github"), ("zerozone-org", "company"), ("zerozone-member", "member"), ("zerozone-branch", "branch"), ("zerozone-code", "code"))
APP_TYPES = ("小程序", "公众号", "微信", "支付宝", "百度", "抖音", "APP", "H5", "iOS", "Android")
PATH_CATEGORIES = ("secret", "admin", "cve_prone", "api", "debug", "auth", "upload")


def value_counts(df: DataFrame, value: Column, name: str, most: int | None = None, fallback: Column | None = None) -> DataFrame:
    """(name, n): how often each value stands, missing ones left out (or counted under ``fallback``); most frequent first."""
    v = value if fallback is None else F.coalesce(value, fallback)
    out = df.select(v.cast("string").alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return out.limit(most) if most else out


def list_counts(df: DataFrame, column: str, name: str, most: int | None = None) -> DataFrame:
    """Like :func:`value_counts` for the elements of a list."""
    out = df.select(F.explode(column).alias("_v")).select(F.trim("_v").alias(name)).where(F.col(name) != "").groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
    return out.limit(most) if most else out


def facets(df: DataFrame, of: Mapping[str, tuple[Column, int]], unknown: str | None = None) -> DataFrame:
    """(facet, value, n): the most frequent values of several columns at once.

    One scan: grouping sets of the columns, a row for each value of each, then the top of each facet by a window
    group limit. ``of``: facet: (column, how many).
    """
    names = list(of)
    cols = [F.coalesce(c.cast("string"), F.lit(unknown)) if unknown else c.cast("string") for c, _ in of.values()]
    wide = df.select(*[c.alias(n) for n, c in zip(names, cols, strict=True)])
    sets = wide.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.count("*").alias("n"), F.grouping_id().alias("_gid"))
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, n in enumerate(names):  # every bit but this column's is set
        here = F.col("_gid") == ((1 << len(names)) - 1) ^ (1 << (len(names) - 1 - i))
        facet, value = F.when(here, n).otherwise(facet), F.when(here, F.col(n)).otherwise(value)
    long = sets.select(facet.alias("facet"), value.alias("value"), "n").where("value IS NOT NULL")
    most = F.element_at(F.create_map(*[F.lit(x) for n, (_, k) in of.items() for x in (n, k)]), F.col("facet"))
    at = Window.partitionBy("facet").orderBy(F.desc("n"), "value")
    return long.withColumn("_at", F.row_number().over(at)).where(F.col("_at") <= max(k for _, k in of.values())).where(F.col("_at") <= most).drop("_at")


def detail(assets: DataFrame) -> DataFrame:
    return assets.select(*flat())


def unique_counts(columns: Mapping[str, Column]) -> list[Column]:
    """Aggregates: how many distinct values each of ``columns`` has, by name."""
    return [F.countDistinct(c).alias(name) for name, c in columns.items()]


def summary(assets: DataFrame) -> DataFrame:
    own = {"ips": F.col("ip"), "domains": F.col("domain"), "roots": root_domain(F.col("domain")), "ports": F.col("port")}
    return assets.agg(F.count("*").alias("total"), *unique_counts(own), F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"))


def by_source(assets: DataFrame) -> DataFrame:
    return value_counts(assets, F.col("source"), "source")


def by_port(assets: DataFrame) -> DataFrame:
    return value_counts(assets, F.col("port"), "port", 50)


def by_product(assets: DataFrame) -> DataFrame:
    return list_counts(assets, "products", "product", 50)


def by_country(assets: DataFrame) -> DataFrame:
    return value_counts(assets, F.col("country"), "country", 50)


def by_city(assets: DataFrame) -> DataFrame:
    return value_counts(assets, F.col("city"), "city", 50)


def by_org(assets: DataFrame) -> DataFrame:
    return value_counts(assets, F.col("org"), "org", 50, F.col("asn"))


def by_tag(assets: DataFrame) -> DataFrame:
    return list_counts(assets, "tags", "tag")


def root_domains(assets: DataFrame, most: int | None = None) -> DataFrame:
    own = assets.withColumn("root_domain", root_domain(F.col("domain"))).where("root_domain IS NOT NULL")
    out = own.groupBy("root_domain").agg(F.countDistinct("domain").alias("subdomains"), F.countDistinct("ip").alias("ips"), F.count("*").alias("assets")).orderBy(F.desc("assets"), "root_domain")
    return out.limit(most) if most else out


def _first_of(df: DataFrame, *key: str) -> DataFrame:
    """The first row by ``seq`` of each key; combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), "seq").alias("_first")).select(*key, "_first.*")


def paths(assets: DataFrame) -> DataFrame:
    """Distinct paths of each host, with how many the host has."""
    query = url_query(F.col("url"))
    path = F.concat(url_path(F.col("url")), F.coalesce(F.concat(F.lit("?"), query), F.lit("")))
    own = assets.where(F.col("url").contains("://")).select(F.coalesce("host", "domain").alias("host"), path.alias("path"), "domain", "url", "title", "server", F.array_join("products", ",").alias("products"), F.array_join("tags", ",").alias("tags"), "source", "seq")
    one = _first_of(own.where("host IS NOT NULL AND path NOT IN ('', '/')"), "host", "path")
    counted = one.join(one.groupBy("host").agg(F.count("*").alias("host_path_count")), "host")
    return counted.select("host_path_count", "host", "domain", "path", "url", "title", "server", "products", "tags", "source").orderBy(F.desc("host_path_count"), "host", "path")


def emails(assets: DataFrame) -> DataFrame:
    in_host = F.nullif(F.lower(F.regexp_extract("host", _EMAIL, 0)), F.lit(""))
    in_title = F.nullif(F.lower(F.regexp_extract("title", _EMAIL, 0)), F.lit(""))
    email = F.coalesce(F.when(F.col("host").contains("@"), in_host), in_title)
    own = assets.withColumn("email", email).where("email IS NOT NULL")
    grouped = own.groupBy("email").agg(F.array_join(F.array_sort(F.collect_set("source")), ", ").alias("sources"), F.min_by(F.struct(F.array_join("tags", ",").alias("tags"), "org", "title", "update_time"), "seq").alias("_f"))
    return grouped.select("email", F.regexp_extract("email", "@([^@]*)$", 1).alias("domain"), "sources", "_f.*").orderBy("domain", "email")


def _listed(assets: DataFrame, *columns: str) -> list[Column]:
    return [F.coalesce(F.array_join(c, ","), F.lit("")).alias(c) if c in LISTS else F.col(c) for c in columns]


def apps(assets: DataFrame) -> DataFrame:
    joined = F.upper(F.coalesce(F.array_join("tags", ","), F.lit("")))
    kind = F.lit("")
    for k in reversed(APP_TYPES):
        kind = F.when(joined.contains(k.upper()), F.lit(k)).otherwise(kind)
    is_app = F.col("service").isin("app", "apk") | F.col("source").rlike(APP_SOURCES)
    return assets.where(F.coalesce(is_app, F.lit(False))).select(kind.alias("type"), *_listed(assets, "service", "title", "url", "icp", "org", "tags", "source", "update_time"), "seq").orderBy("type", "org", "title", "seq").drop("seq")


def supply(assets: DataFrame) -> DataFrame:
    bucket = F.lit("other")
    for needle, label in reversed(SUPPLY_BUCKETS):
        bucket = F.when(F.col("source").contains(needle), F.lit(label)).otherwise(bucket)
    return assets.where(F.col("source").rlike(SUPPLY_SOURCES)).select(bucket.alias("bucket"), *_listed(assets, "host", "domain", "ip", "port", "url", "title", "org", "icp", "tags", "source", "update_time"), "seq").orderBy("bucket", "org", "seq").drop("seq")


def leak_index(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("source").rlike(LEAK_SOURCES)).select(*_listed(assets, "source", "host", "domain", "url", "title", "tags", "org", "update_time"), "seq").orderBy("source", "host", "seq").drop("seq")


def sensitive_paths(assets: DataFrame) -> DataFrame:
    tags = F.transform("tags", lambda t: F.trim(t))
    category = F.get(F.filter(tags, lambda t: F.when(t == "cve_proned", "cve_prone").otherwise(t).isin(*PATH_CATEGORIES)), F.lit(0))
    category = F.when(category == "cve_proned", "cve_prone").otherwise(category)
    template = F.substring(F.get(F.filter(tags, lambda t: t.startswith("template:")), F.lit(0)), 10, 1000)
    return assets.where(tagged("high-value", "template:")).select(F.coalesce(category, F.lit("")).alias("category"), F.coalesce(template, F.lit("")).alias("template"), *_listed(assets, "host", "url", "title", "server", "products", "tags", "source"), "seq").orderBy("category", "template", "host", "seq").drop("seq")


def certificates(assets: DataFrame, no_subject: str = "(无主体)") -> DataFrame:
    own = assets.where(F.col("cert_subject").isNotNull() | F.col("cert_issuer").isNotNull() | (F.size("cert_domains") > 0))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("cert_domains"))))
    out = own.groupBy(F.coalesce("cert_subject", F.lit(no_subject)).alias("subject")).agg(
        F.count("*").alias("assets"), F.countDistinct("ip").alias("ips"), F.countDistinct("domain").alias("domains"),
        F.substring(F.array_join(F.array_sort(F.collect_set("cert_issuer")), ", "), 1, 200).alias("issuers"),
        F.substring(F.array_join(names, ", "), 1, 300).alias("cert_domains"),
    )
    return out.orderBy(F.desc("assets"), "subject")


def ct_subdomains(assets: DataFrame) -> DataFrame:
    own = assets.where(F.col("source").rlike(CT_SOURCES)).withColumn("_key", F.coalesce("domain", "host")).where("_key IS NOT NULL")
    return _first_of(own.select("_key", "domain", "host", "ip", "source", "update_time", "seq"), "_key").select("domain", "host", "ip", "source", "update_time").orderBy("domain", "host")


def archived(assets: DataFrame) -> DataFrame:
    own = assets.where(F.col("source").startswith("wayback") & F.col("url").isNotNull())
    return _first_of(own.select("url", "host", "domain", "title", "update_time", "source", "seq"), "url").select("url", "host", "domain", "title", "update_time", "source").orderBy("host", "url")


def cdn(assets: DataFrame) -> DataFrame:
    own = assets.where(F.array_contains(F.coalesce("tags", F.array().cast("array<string>")), "CDN"))
    return own.select(*_listed(assets, "host", "domain", "ip", "org", "isp", "server", "tags", "source"), "seq").orderBy("org", "host", "seq").drop("seq")


def cross_source(assets: DataFrame) -> DataFrame:
    return assets.where(F.col("source").contains("+")).select(*_listed(assets, "source", "ip", "port", "protocol", "domain", "host", "url", "service", "title", "server", "products", "country", "city", "org", "icp", "tags", "update_time"))


def risky(assets: DataFrame) -> DataFrame:
    return assets.where(tagged("敏感端口", "后台", "登录")).select(*_listed(assets, "source", "ip", "port", "domain", "host", "url", "title", "server", "products", "country", "city", "org", "tags", "update_time"))


def stats(assets: DataFrame) -> DataFrame:
    """The dashboard's facets; tags apart, since a row has many."""
    one = facets(assets, {"source": (F.col("source"), 20), "country": (F.col("country"), 20), "port": (F.col("port"), 20), "asn": (F.col("asn"), 20), "protocol": (F.col("protocol"), 10), "service": (F.col("service"), 20)})
    return one.union(list_counts(assets, "tags", "value", 30).select(F.lit("tag").alias("facet"), "value", "n"))


def analysis(assets: DataFrame, unknown: str = "未知") -> DataFrame:
    own = {"root": (root_domain(F.col("domain")), 50), "country": (F.col("country"), 50), "city": (F.col("city"), 50), "org": (F.col("org"), 50), "isp": (F.col("isp"), 50)}
    return facets(assets, own, unknown)


def parameters(urls: DataFrame, classify) -> DataFrame:
    """Per lower-cased query parameter of ``urls`` (url, ts, seq): count, risk kinds, first URL and value, first and last ts."""
    pairs = F.split(url_query(F.col("url")), "&")
    own = urls.select("url", "ts", "seq", F.posexplode(pairs).alias("at", "pair")).where("pair <> ''")
    name = F.try_url_decode(F.replace(F.regexp_extract("pair", "^([^=]*)", 1), F.lit("+"), F.lit(" ")))
    own = own.select("url", "ts", "seq", "at", F.lower(name).alias("param"), F.substring(F.regexp_extract("pair", "=(.*)$", 1), 1, 80).alias("value"))
    own = own.where((F.col("param") != "") & (F.length("param") <= 60))
    # a URL counts once for a name, with the value that stands first
    once = own.groupBy("seq", "url", "ts", "param").agg(F.min_by("value", "at").alias("value"))
    out = once.groupBy("param").agg(F.count("*").alias("n"), F.min_by("url", "seq").alias("sample_url"), F.min_by("value", "seq").alias("sample_value"), F.min_by("ts", "seq").alias("first_ts"), F.max_by("ts", "seq").alias("last_ts"))
    return out.withColumn("risks", F.array_join(classify(F.col("param")), ",")).orderBy(F.desc("n"), "param")


def progress(events: DataFrame) -> DataFrame:
    """One row: how many sources started, finished and failed."""
    return events.agg(F.count_if(F.col("phase") == "start").alias("started"), F.count_if(F.col("phase") == "done").alias("finished"), F.count_if((F.col("phase") == "done") & F.col("err").isNotNull()).alias("failed"))


def vendor_statistics(hosts: DataFrame) -> DataFrame:
    """(name, n) of ``hosts`` (host, cdn, vendors, origins): hosts, those behind a network, origin candidates, and hosts of each vendor."""
    totals = hosts.agg(F.count("*").alias("hosts"), F.count_if("cdn").alias("hosts_with_cdn"), F.coalesce(F.sum(F.size(F.coalesce("origins", F.array().cast("array<string>")))), F.lit(0)).alias("origin_candidates"))
    named = totals.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("n")) for c in totals.columns])))
    vendors = hosts.select("host", F.explode("vendors").alias("v")).groupBy(F.concat(F.lit("vendor:"), "v").alias("name")).agg(F.count("*").alias("n"))
    return named.unionByName(vendors)


def page_statistics(pages: DataFrame) -> DataFrame:
    """One row of sums over ``pages`` (err, status and the lists emails, phones, icp_numbers, meta, external_links, robots_paths, sitemap_urls)."""
    good = (F.coalesce("err", F.lit("")) == "") & (F.coalesce("status", F.lit(0)) != 0)
    lists = ("emails", "phones", "icp_numbers", "meta", "external_links", "robots_paths", "sitemap_urls")
    size = lambda c: F.coalesce(F.sum(F.when(F.col(c).isNotNull(), F.size(c))), F.lit(0)).alias(c)
    return pages.agg(F.count("*").alias("targets"), F.count_if(good).alias("ok"), F.count_if(~good).alias("errors"), *[size(c) for c in lists if c in pages.columns])


def crawl_statistics(pages: DataFrame) -> DataFrame:
    """One row over ``pages`` (url, content_type, err, matches: array<struct<type, rule, value>>): pages, errors, scripts, distinct endpoints and distinct secrets."""
    script = F.lower("content_type").contains("javascript") | F.lower("url").endswith(".js")
    sums = pages.agg(F.count("*").alias("pages"), F.count_if(F.coalesce("err", F.lit("")) != "").alias("errors"), F.count_if(F.coalesce(script, F.lit(False))).alias("scripts"))
    # distinct values are counted by groups, which combine before the shuffle
    found = pages.select(F.explode("matches").alias("m")).select(F.col("m.type").alias("type"), F.when(F.col("m.type") == "secret", F.col("m.rule")).alias("rule"), F.col("m.value").alias("value")).distinct()
    return sums.crossJoin(found.agg(F.count_if(F.col("type") == "endpoint").alias("endpoints"), F.count_if(F.col("type") == "secret").alias("secrets")))


SHEETS = {
    "detail": detail, "summary": summary, "by_source": by_source, "by_port": by_port, "by_product": by_product, "by_country": by_country, "by_city": by_city, "by_org": by_org,
    "root_domains": root_domains, "by_tag": by_tag, "paths": paths, "emails": emails, "apps": apps, "supply": supply, "leak_index": leak_index, "sensitive_paths": sensitive_paths,
    "certificates": certificates, "ct_subdomains": ct_subdomains, "archived": archived, "cdn": cdn, "cross_source": cross_source, "risky": risky,
}


def sheets(assets: DataFrame, names: Sequence[str] = tuple(SHEETS)) -> dict[str, DataFrame]:
    return {n: SHEETS[n](assets) for n in names}
