"""Queries that go through files and back: imports, target lists, sessions, sinks, records of other tools, and statistics.

What they write lies in new folders below the session's shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import web
from quarrylight.operators import diff, report
from quarrylight.plans.fixtures import ASSETS_SQL as A
from quarrylight.plans.fixtures import assets
from quarrylight.plans.queries import _CATALOGUE, _tagged_pages, reports
from quarrylight.plans.registry import query, table
from quarrylight.sources import imports, records, store, workbooks
from quarrylight.streaming import progress


def _host() -> Column:
    return F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1))


def _folder(spark: SparkSession) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{at or '/tmp/checkpoints'}/files-{uuid.uuid4().hex}"


_HOST_SQL = "lower(regexp_extract(url, '://([^/?#:]+)', 1))"


# ---- imports -----------------------------------------------------------------------------------------------------


@query("f1_f13_workbook", f"{A} SELECT host, ip, port, title FROM a WHERE coalesce(host, domain, url, ip) IS NOT NULL")
def f1(spark, sf):
    at = f"{_folder(spark)}/report.xlsx"
    store.export(assets(spark, sf), at)  # every sheet; the first has each asset
    return imports.imported(imports.read_xlsx(spark, at)).select("host", "ip", "port", "title")


def _foreign(spark: SparkSession, sf: str, names: dict[str, str]) -> DataFrame:
    p = table(spark, sf, "pages")
    own = {"n": F.col("page_id").cast("string"), "h": _host(), "u": F.col("url"), "p": F.concat(F.col("page_id") + 1, F.lit(".0")), "products": F.lit("[{web nginx} {lang  PHP}]"), "parts": F.lit("[nginx|1.2, PHP]"), "names": F.lit("['a.x', 'b.x']"), "c": F.lit("DE")}
    return p.select(F.col("page_id").alias("seq"), *[own[v].alias(k) for k, v in names.items()])


@query("f3_fofa_export", f"SELECT page_id AS seq, {_HOST_SQL} AS host, url, CAST(page_id + 1 AS INT) AS port, 'nginx,PHP' AS products, 'a.x,b.x' AS cert_domains, 'DE' AS country, 'fofa_xlsx' AS source FROM pages")
def f3(spark, sf):
    rows = _foreign(spark, sf, {"主机名": "h", "链接": "u", "端口": "p", "产品名": "products", "证书域名": "names", "国家代码": "c"})
    return imports.from_fofa(rows).select("seq", "host", "url", "port", F.array_join("products", ",").alias("products"), F.array_join("cert_domains", ",").alias("cert_domains"), "country", "source")


@query("f4_quake_export", f"SELECT page_id AS seq, {_HOST_SQL} AS host, url, CAST(page_id + 1 AS INT) AS port, 'nginx,1.2,PHP' AS products, 'DE' AS country, 'quake_xlsx' AS source FROM pages")
def f4(spark, sf):
    rows = _foreign(spark, sf, {"主机名": "h", "链接": "u", "端口": "p", "组件": "parts", "国家代码": "c"})
    return imports.from_quake(rows).select("seq", "host", "url", "port", F.array_join("products", ",").alias("products"), "country", "source")


@query("f6_detected_csv", f"SELECT {_HOST_SQL} AS host, url, CAST(page_id + 1 AS INT) AS port, source FROM pages CROSS JOIN (VALUES ('fofa_xlsx'), ('quake_xlsx'), ('recon_xlsx')) AS v(source)")
def f6(spark, sf):
    at, kinds = _folder(spark), {"fofa": {"主机名": "h", "链接": "u", "端口": "p", "标题": "n", "产品名": "products"}, "quake": {"主机名": "h", "链接": "u", "端口": "p", "网页标题": "n", "组件": "parts"}, "own": {"host": "h", "url": "u", "port": "p", "title": "n", "country": "c"}}
    out = None
    for kind, names in kinds.items():
        _foreign(spark, sf, names).drop("seq").write.csv(f"{at}/{kind}", header=True, escape='"')
        one = imports.imported(imports.read_csv(spark, f"{at}/{kind}")).select("host", "url", "port", "source")
        out = one if out is None else out.unionByName(one)
    return out


@query("f8_f9_target_files", f"SELECT DISTINCT unnest([{_HOST_SQL}, 't' || page_id || '.example.net', '10.0.0.' || (page_id % 9)]) AS target FROM pages")
def f8(spark, sf):
    at = _folder(spark)
    lines = table(spark, sf, "pages").select(F.concat(_host(), F.lit("; t"), F.col("page_id"), F.lit(".example.net,10.0.0."), F.col("page_id") % 9, F.lit(" # a, comment")).alias("value"))
    lines.write.text(at)
    return imports.read_targets(spark, at).select("target")


@query(
    "f8_every_cell",
    f"""{A}, x AS (SELECT seq, UNNEST([trim(title), host, trim(org), cert_subject]) AS v FROM a), u AS (SELECT v AS target FROM x UNION SELECT unnest(['host', 'title', 'org', 'cert_subject']))
    SELECT DISTINCT target FROM u WHERE target <> ''""",
)
def f8_cells(spark, sf):
    """Targets from every cell of three workbooks, each of two sheets, written from the assets."""
    at, own = _folder(spark), assets(spark, sf)
    for n in range(3):
        part = own.where(F.pmod("seq", F.lit(3)) == n)
        sheets = {"names": part.orderBy("seq").select("host", "title"), "owners": part.orderBy("seq").select("org", "cert_subject")}
        workbooks.write_sheets(sheets, f"{at}-{n}.xlsx", store.sink(spark, f"{at}-{n}.xlsx"), piece_rows=50)
    return imports.read_targets(spark, ",".join(f"{at}-{n}.xlsx" for n in range(3))).select("target")


@query("f8_csv_cells", "SELECT DISTINCT target FROM (SELECT trim(unnest([CAST(page_id AS VARCHAR), url, trim(regexp_extract(html, '<title>([^<]*)</title>', 1))])) AS target FROM pages) WHERE target <> ''")
def f8_csv(spark, sf):
    at = f"{_folder(spark)}.csv"
    table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title")).write.csv(at, escape='"')
    return imports.read_targets(spark, at).select("target")


def _whole_workbook_sql() -> str:
    of = [f"SELECT '{sheet}' AS sheet, name, value FROM (UNPIVOT (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({sql})) ON COLUMNS(*) INTO NAME name VALUE value)" for sheet, sql in reports().values()]
    return f"SELECT sheet, name, value, count(*) AS n FROM ({' UNION ALL '.join(of)}) WHERE value <> '' GROUP BY ALL"


@query("f13_whole_workbook", _whole_workbook_sql())
def f13_whole(spark, sf):
    """Every cell of every sheet of a report, written to a workbook and read again."""
    at = f"{_folder(spark)}.xlsx"
    store.write_workbook(assets(spark, sf), at)
    rows = workbooks.read_rows(spark, at)
    heads = rows.where("row = 1").select("sheet", F.col("cells").alias("names"))
    cells = rows.where("row > 1").join(F.broadcast(heads), "sheet").select("sheet", F.inline(F.arrays_zip("names", "cells"))).toDF("sheet", "name", "value")
    return cells.where("value <> ''").groupBy("sheet", "name", "value").agg(F.count("*").alias("n"))


# ---- sessions and sinks ------------------------------------------------------------------------------------------


@query("f10_f12_sessions", f"{A} SELECT 1 AS session_id, 'one' AS name, 'kept' AS notes, count(*) AS assets, count(*) AS loaded, 2 * count(*) AS raw_rows, count(DISTINCT seq) AS n FROM a")
def f10(spark, sf):
    own = assets(spark, sf)
    s = store.SessionStore(spark, _folder(spark))
    first, second = s.save("one", own, raw=own.unionByName(own)), s.save("two", own.limit(1))
    s.set_notes(first, "kept")
    s.delete(second)
    sums = s.load(first).agg(F.count("*").alias("loaded"), F.countDistinct("seq").alias("n")).crossJoin(s.load(first, raw=True).agg(F.count("*").alias("raw_rows")))
    return s.list().select(F.col("session_id").cast("int").alias("session_id"), "name", "notes", "assets").crossJoin(sums)


@query("f13_report_folders", f"{A} SELECT CAST(port AS INT) AS port, count(*) AS n FROM a WHERE port IS NOT NULL GROUP BY 1")
def f13(spark, sf):
    at = _folder(spark)
    store.write_report(assets(spark, sf), at, names=("summary", "by_port", "detail"))
    back = spark.read.parquet(f"{at}/by_port")
    return back.select(F.col(back.columns[0]).cast("int").alias("port"), F.col("n").cast("long").alias("n"))


@query("f14_sinks", f"{A} SELECT 'csv' AS kind, count(*) AS n, count(host) AS hosts FROM a UNION ALL SELECT 'json', count(*), count(host) FROM a UNION ALL SELECT 'parquet', count(*), count(host) FROM a UNION ALL SELECT 'txt', count(host), count(host) FROM a UNION ALL SELECT 'yaml', count(*), count(host) FROM a")
def f14(spark, sf):
    at, own = _folder(spark), assets(spark, sf)
    for kind in ("csv", "json", "parquet", "txt", "yaml"):
        store.export(own, f"{at}/o.{kind}")
    counted = lambda df, kind, there: df.agg(F.count("*").alias("n"), F.count_if(there).alias("hosts")).select(F.lit(kind).alias("kind"), "n", "hosts")
    yaml = spark.read.text(f"{at}/o.yaml").agg(F.count_if(F.col("value") == "-").alias("n"), F.count_if(F.col("value").startswith("  host: ")).alias("hosts")).select(F.lit("yaml").alias("kind"), "n", "hosts")
    out = counted(spark.read.csv(f"{at}/o.csv", header=True, escape='"'), "csv", F.col("host") != "")
    out = out.union(counted(spark.read.schema("host string").json(f"{at}/o.json"), "json", F.col("host").isNotNull()))
    out = out.union(counted(spark.read.parquet(f"{at}/o.parquet"), "parquet", F.col("host").isNotNull()))
    return out.union(counted(spark.read.text(f"{at}/o.txt"), "txt", F.col("value") != "")).union(yaml)


@query("f15_parameter_lists", "WITH p AS (SELECT url, unnest(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&')) AS pair FROM pages WHERE contains(url, '?')) SELECT 'name' AS kind, count(DISTINCT lower(regexp_extract(pair, '^([^=]*)', 1))) AS n FROM p WHERE regexp_extract(pair, '^([^=]*)', 1) <> '' UNION ALL SELECT 'url', count(DISTINCT url) FROM p")
def f15(spark, sf):
    at, urls = _folder(spark), table(spark, sf, "pages").select("url", F.lit("1").alias("ts"), F.col("page_id").alias("seq"))
    records.parameter_lists(report.parameters(urls, lambda c: F.array(c)), urls, at)
    return spark.read.text(f"{at}/names").agg(F.count("*").alias("n")).select(F.lit("name").alias("kind"), "n").union(spark.read.text(f"{at}/urls").agg(F.count("*").alias("n")).select(F.lit("url").alias("kind"), "n"))


# ---- records of other tools --------------------------------------------------------------------------------------


@query("a1_a3_a6_a14_records", f"""SELECT {_HOST_SQL} AS host, '10.0.0.1' AS ip, CASE page_id % 3 WHEN 0 THEN 22 WHEN 1 THEN 3269 ELSE 6661 END AS port, CASE page_id % 3 WHEN 0 THEN 'ssh' WHEN 1 THEN 'ldaps-gc' ELSE 'irc' END AS service, 'portscan' AS source FROM pages
UNION ALL SELECT 's' || page_id || '.example.net', '10.0.0.2', NULL, NULL, 'subdomain' FROM pages WHERE page_id % 2 = 0""")  # fmt: skip
def a1(spark, sf):
    at, p = _folder(spark), table(spark, sf, "pages")
    port = F.get(F.array(F.lit(22), F.lit(3269), F.lit(6661)), (F.col("page_id") % 3).cast("int"))
    p.select(_host().alias("target"), F.lit("10.0.0.1").alias("ip"), port.alias("port"), F.lit("").alias("service"), F.lit("b").alias("banner")).write.json(f"{at}/port")
    p.select(F.concat(F.lit("s"), "page_id", F.lit(".example.net")).alias("name"), F.array(F.lit("10.0.0.2")).alias("ips"), F.lit("").alias("cname"), (F.col("page_id") % 2 == 1).alias("wildcard")).write.json(f"{at}/subdomain")
    out = records.port_assets(records.read(spark, f"{at}/port", "port")).unionByName(records.subdomain_assets(records.read(spark, f"{at}/subdomain", "subdomain")))
    return out.select("host", "ip", "port", "service", "source")


# ---- statistics and findings ---------------------------------------------------------------------------------------


@query("r26_vendor_statistics", "WITH h AS (SELECT page_id, page_id % 3 AS k FROM pages) SELECT name, n FROM (SELECT 'hosts' AS name, count(*) AS n FROM h UNION ALL SELECT 'hosts_with_cdn', count(*) FILTER (WHERE k < 2) FROM h UNION ALL SELECT 'origin_candidates', 2 * count(*) FILTER (WHERE k = 0) FROM h UNION ALL SELECT 'vendor:cloudflare', count(*) FILTER (WHERE k < 2) FROM h UNION ALL SELECT 'vendor:akamai', count(*) FILTER (WHERE k = 0) FROM h)")
def r26_vendors(spark, sf):
    k = F.col("page_id") % 3
    none = F.array().cast("array<string>")
    vendors = F.when(k == 0, F.array(F.lit("cloudflare"), F.lit("akamai"))).when(k == 1, F.array(F.lit("cloudflare"))).otherwise(none)
    return report.vendor_statistics(table(spark, sf, "pages").select(_host().alias("host"), (k < 2).alias("cdn"), vendors.alias("vendors"), F.when(k == 0, F.array(F.lit("10.0.0.1"), F.lit("10.0.0.2"))).alias("origins")))


@query("r26_page_statistics", "SELECT count(*) AS targets, count(*) FILTER (WHERE page_id % 4 > 0) AS ok, count(*) FILTER (WHERE page_id % 4 = 0) AS errors, CAST(coalesce(sum(len(list_distinct(list_transform(regexp_extract_all(html, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}'), lambda x: lower(x))))), 0) AS BIGINT) AS emails, 2 * count(*) AS robots_paths FROM pages")
def r26_pages(spark, sf):
    from quarrylight.functions import text

    p = table(spark, sf, "pages").select(F.when(F.col("page_id") % 4 == 0, "timeout").alias("err"), F.lit(200).alias("status"), text.contacts(F.col("html"))["emails"].alias("emails"), F.array(F.lit("/a"), F.lit("/b")).alias("robots_paths"))
    return report.page_statistics(p)


@query("r26_crawl_statistics", "SELECT count(*) AS pages, count(*) FILTER (WHERE page_id % 5 = 0) AS errors, count(*) FILTER (WHERE page_id % 2 = 0 OR lower(url) LIKE '%.js') AS scripts, count(DISTINCT url) AS endpoints, count(DISTINCT page_id % 3) AS secrets FROM pages")
def r26_crawl(spark, sf):
    match = lambda kind, rule, value: F.struct(F.lit(kind).alias("type"), F.lit(rule).alias("rule"), value.alias("value"))
    found = F.array(match("endpoint", "absolute_url", F.col("url")), match("secret", "jwt", (F.col("page_id") % 3).cast("string")))
    kind = F.when(F.col("page_id") % 2 == 0, "application/JavaScript").otherwise("text/html")
    return report.crawl_statistics(table(spark, sf, "pages").select("url", kind.alias("content_type"), F.when(F.col("page_id") % 5 == 0, "x").alias("err"), found.alias("matches")))


_BODIES = {"env": "KEY=1", "json": '{"a": 1}', "": "x"}
_RULE_ROWS = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in (p, c, s, _BODIES.get(n, f"x {n.split('|')[-1]}"))) + ")" for p, c, s, n in web.PATH_RULES)


@query("x15_path_rules", f"SELECT url, path, category, severity FROM pages CROSS JOIN (VALUES {_RULE_ROWS}) AS v(path, category, severity, body) WHERE page_id % 3 = 0")
def x15(spark, sf):
    # of three pages one serves the file, one its front page for every path, one answers 404
    rules = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(_BODIES.get(n, f"x {n.split('|')[-1]}")).alias("body")) for p, _, _, n in web.PATH_RULES])
    k = F.col("page_id") % 3
    each = table(spark, sf, "pages").select("url", k.alias("k"), F.inline(rules))
    served = each.select("url", "path", F.when(F.col("k") == 2, 404).otherwise(200).alias("status"), F.when(F.col("k") == 1, "text/html").otherwise("text/plain").alias("content_type"), F.when(F.col("k") == 1, "<html>home</html>").otherwise(F.col("body")).alias("body"))
    # a front page in the place of a folder or of an HTML file can't be told from it without more
    return web.path_findings(served.where((F.col("k") != 1) | F.col("path").rlike(r"\.(json|sql|env|zip|gz|config|php|yaml|yml|xml|txt)$")))


@query("x17_services", "SELECT port, CASE WHEN port BETWEEN 6660 AND 6667 THEN 'irc' ELSE service END AS service FROM (SELECT p_partkey AS port FROM part WHERE p_partkey <= 65535) LEFT JOIN (VALUES " + ", ".join(f"({p}, '{s}')" for p, s in web.SERVICES.items()) + ") AS v(number, service) ON number = port")
def x17(spark, sf):
    return table(spark, sf, "part").where("p_partkey <= 65535").select(F.col("p_partkey").alias("port"), web.port_service(F.col("p_partkey").cast("int")).alias("service"))


@query("x22_references", f"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/a/b.js' AS rooted, regexp_extract(url, '^([a-z]+):', 1) || '://cdn.example.net/x' AS schemeless, 'https://example.net/y' AS absolute, {_HOST_SQL} LIKE '%.example.com' OR {_HOST_SQL} = 'example.com' AS own FROM pages")
def x22(spark, sf):
    ref = lambda r: web.resolved(F.col("url"), F.lit(r))
    own = F.regexp_extract(_host(), r"([^.]+\.[^.]+)$", 1)
    return table(spark, sf, "pages").select("page_id", ref("/a/b.js").alias("rooted"), ref("//cdn.example.net/x").alias("schemeless"), ref("https://example.net/y").alias("absolute"), web.same_host(own, F.lit("example.com")).alias("own"))


@query("v1_change_sample", f"{A}, k AS (SELECT DISTINCT ip FROM a WHERE ip IS NOT NULL), x AS (SELECT DISTINCT ip FROM a WHERE ip IS NOT NULL AND seq % 2 = 0), y AS (SELECT DISTINCT ip FROM a WHERE ip IS NOT NULL AND seq % 3 = 0) SELECT 'added' AS change, ip AS key FROM (SELECT ip FROM y EXCEPT SELECT ip FROM x ORDER BY ip LIMIT 20) UNION ALL SELECT 'removed', ip FROM (SELECT ip FROM x EXCEPT SELECT ip FROM y ORDER BY ip LIMIT 20)")
def v1_sample(spark, sf):
    own = assets(spark, sf)
    before, after = own.where("seq % 2 = 0"), own.where("seq % 3 = 0")
    one = lambda c: diff.change_sample(before, after, c, 20, "ip").select(F.lit(c).alias("change"), "key")
    return one("added").unionByName(one("removed"))


@query("w4_stopped", "SELECT event_type, count(*) AS n, false AS active FROM events GROUP BY 1")
def w4_stopped(spark, sf):
    """A running stream is stopped once it has taken what is there; its counts stay."""
    path, name = f"{sf}/events.parquet", f"w4_{uuid.uuid4().hex}"
    running = progress.start(progress.phase_counts(progress.event_stream(spark, path, spark.read.parquet(path).schema)), name)
    running.processAllAvailable()
    running.stop()
    return spark.table(name).select("event_type", "n", F.lit(running.isActive).alias("active"))


_HUB = '[{"name":"Hub","path":"/","request_method":"get","headers":{"server":"even"},"keyword":["<TITLE>","<meta"],"favicon_hash":["-77"]},{"name":"Deep","path":"/x","keyword":["<title>"]}]'
_WORDS = '{"fingerprint":[{"cms":"Words","method":"keyword","location":"body","keyword":["<meta charset"]},{"cms":"Noise","keyword":["login"]},{"cms":"Titled","location":"title","keyword":["th"]},{"cms":"Icon","method":"faviconhash","keyword":["-5"]}]}'
_APPS = r'{"apps":{"Even":{"headers":{"Server":"even(\\d)?\\;version:\\1"}},"Meta":{"html":["<META charset=\"?utf-8\\;confidence:50"]},"Session":{"cookies":{"SID":"a[0-9]"}},"Broken":{"html":"(("}}}'


@query("x3_rule_files", """WITH p AS (SELECT page_id AS id, lower(html) AS b, page_id % 2 = 0 AS even, page_id % 5 = 0 AS icon, page_id % 7 = 0 AS other, lower(regexp_extract(html, '<title>([^<]*)', 1)) AS t FROM pages)
SELECT id, 'Hub' AS product FROM p WHERE icon OR even AND contains(b, '<title>') AND contains(b, '<meta') UNION SELECT id, 'Words' FROM p WHERE contains(b, '<meta charset') UNION SELECT id, 'Titled' FROM p WHERE contains(t, 'th') UNION SELECT id, 'Icon' FROM p WHERE other AND NOT icon
UNION SELECT id, 'Even' FROM p WHERE even UNION SELECT id, 'Meta' FROM p WHERE contains(b, '<meta charset="utf-8') OR contains(b, '<meta charset=utf-8') UNION SELECT id, 'Session' FROM p WHERE icon""")  # fmt: skip
def x3_files(spark, sf):
    from quarrylight.functions import rules

    at = _folder(spark)
    for name, text in (("hub", _HUB), ("words", _WORDS), ("apps", _APPS)):
        spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(f"{at}/{name}")
    even = F.col("page_id") % 2 == 0
    p = table(spark, sf, "pages").select(
        F.col("page_id").alias("id"), F.when(even, "server: even").alias("header"), F.col("html").alias("body"), F.regexp_extract("html", "<title>([^<]*)", 1).alias("title"), F.when(F.col("page_id") % 5 == 0, "x=1; SID=a1").alias("cookie"),
        F.when(F.col("page_id") % 5 == 0, "-77").when(F.col("page_id") % 7 == 0, "-5").alias("favicon"), F.when(even, F.create_map(F.lit("Server"), F.lit("Even1"))).alias("headers"),
    )
    needles = rules.read_hub_rules(spark, f"{at}/hub").unionByName(rules.read_keyword_rules(spark, f"{at}/words"))
    return rules.matched(p, needles).union(rules.matched_patterns(p, rules.read_pattern_rules(spark, f"{at}/apps"))).distinct()


@query("p14_template_choice", f"WITH {_CATALOGUE} SELECT page_id, id, category FROM g WHERE category = 'api' OR id = 'jenkins'")
def p14(spark, sf):
    """Pages of the templates that were chosen, by category and by name."""
    chosen = records.templates(spark, categories=("api",)).unionByName(records.templates(spark, ids=("jenkins", "swagger_ui"), categories=("admin",)))
    found = _tagged_pages(spark, sf).select("page_id", F.regexp_extract("label", "^template:(.*)", 1).alias("id"))
    return found.join(F.broadcast(chosen), "id").select("page_id", "id", "category")
