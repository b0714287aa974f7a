"""Queries of operators that meet large rule, target and prefix tables, workbooks, growing sessions and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.functions import dsl, rules, scripts
from quarrylight.operators import filters, growing, joins, report
from quarrylight.plans.fixtures import ASSETS_SQL as A
from quarrylight.plans.fixtures import assets
from quarrylight.plans.queries import ROOT
from quarrylight.plans.registry import SQL, folder, query, table
from quarrylight.sources import records
from quarrylight.streaming import cursor, deadlines, progress

_HOST_SQL = "lower(regexp_extract(url, '://([^/?#:]+)', 1))"


# ---- rule tables of regular expressions ------------------------------------------------------------------------------

#: Made of each page: its path in a link, words of its title with anything between, alternatives, a pattern without a literal, one that is no expression.
_PATTERNS = (
    ("link", "'href=\"/' || word || '\"'", "page_id % 3 = 0"),
    ("title", "'<title>[^<]*' || word || '[^<]{0,40}</title>'", "page_id % 3 = 1"),
    ("either", "'(?:' || word || '|track\\(' || CAST(page_id AS STRING) || '\\))(?:[.,]|</)'", "page_id % 3 = 2"),
    ("short", "'[' || substring(word, 1, 1) || ']' || '[0-9]{2}'", "page_id % 40 = 0"),
)
_WORD = "lower(regexp_extract(url, '://([a-z]+)', 1))"


def _patterns_sql(engine: str) -> str:
    text = " UNION ALL ".join(f"SELECT concat('{name}-', CAST(page_id % 25 AS STRING)) AS product, {pattern} AS pattern FROM w WHERE {where}" for name, pattern, where in _PATTERNS)
    head = f"w AS (SELECT page_id, {_WORD} AS word FROM pages WHERE {_WORD} <> '')"
    if engine == "spark":  # a string literal takes a backslash twice there
        text = text.replace("\\", "\\\\")
    return f"{head}, r AS ({text})"


@query("x3_pattern_rules", f"WITH {_patterns_sql('duckdb')} SELECT DISTINCT page_id, product FROM pages JOIN (SELECT DISTINCT product, pattern FROM r) AS q ON regexp_matches(html, pattern, 'is')")
def x3_patterns(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    pages.createOrReplaceTempView("x3_pages")
    made = spark.sql(f"WITH {_patterns_sql('spark').replace('FROM pages', 'FROM x3_pages')} SELECT DISTINCT product, 'body' AS place, '' AS name, pattern FROM r")
    own = pages.select("page_id", F.lit(None).cast("map<string,string>").alias("headers"), F.col("html").alias("body"), F.lit("").alias("cookie"))
    return rules.matched_patterns(own, made, "page_id")


# ---- many targets, both families of addresses ---------------------------------------------------------------------------

_NAMES = "list_filter(list_concat([lower(host), lower(domain), nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '')], coalesce(cert_domains, [])), lambda x: x IS NOT NULL)"


@query(
    "p6_many_targets",
    f"""{A}, t AS (SELECT DISTINCT {_HOST_SQL} AS target FROM pages UNION SELECT DISTINCT regexp_extract({_HOST_SQL}, '([^.]+[.][^.]+)$', 1) FROM pages UNION SELECT '10.0.1.' || (page_id % 50) FROM pages UNION SELECT 'm.other.net'),
    n AS (SELECT DISTINCT seq, unnest({_NAMES}) AS h FROM a)
    SELECT DISTINCT seq, target FROM n JOIN t ON h = target OR h LIKE '%.' || target OR list_contains(string_split_regex(h, '[._\\-]'), string_split(target, '.')[1]) WHERE NOT regexp_matches(target, '^[0-9.]+$')
    UNION SELECT seq, target FROM a JOIN t ON ip = target""",
)
def p6_many(spark: SparkSession, sf: str) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1))
    last = F.regexp_extract(host, "([^.]+[.][^.]+)$", 1)
    targets = table(spark, sf, "pages").select(F.explode(F.array(host, last, F.concat(F.lit("10.0.1."), F.col("page_id") % 50), F.lit("m.other.net"))).alias("target"))
    return filters.relevant_to(assets(spark, sf), targets)


#: Addresses of both families from keys; the last group is all that differs within a /112.
_V6 = "'2001:db8:' || lower(printf('%x', {k} % 7)) || '::' || lower(printf('%x', {k} % 300))"


@query(
    "j3_prefix_join_both",
    f"""WITH i AS (SELECT DISTINCT {_V6.format(k="s_suppkey")} AS ip, s_suppkey % 7 AS g, s_suppkey % 300 AS h FROM supplier)
    SELECT ip, CASE WHEN g = 3 THEN '2001:DB8:3:0::/64' WHEN g = 4 AND h < 256 THEN '2001:db8:4::/120' WHEN g = 5 AND h BETWEEN 16 AND 31 THEN '2001:db8:5::10/124' WHEN g < 4 THEN '2001:db8::/46' ELSE '2001:db8::/32' END AS prefix FROM i
    UNION ALL SELECT DISTINCT '10.' || (s_suppkey % 4) || '.0.' || (s_suppkey % 9), CASE s_suppkey % 4 WHEN 0 THEN '10.0.0.0/16' WHEN 1 THEN '::ffff:10.1.0.0/112' WHEN 2 THEN '10.0.0.0/8' ELSE '10.0.0.0/8' END FROM supplier""",
)
def j3_both(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    six = F.concat(F.lit("2001:db8:"), F.lower(F.hex(k % 7)), F.lit("::"), F.lower(F.hex(k % 300)))
    four = F.concat(F.lit("10."), k % 4, F.lit(".0."), k % 9)
    own = s.select(F.explode(F.array(six, four)).alias("ip")).distinct()
    nets = s.groupBy().agg(F.max(F.lit(1))).select(F.explode(F.array(*[F.lit(x) for x in ("2001:db8::/32", "2001:db8::/46", "2001:DB8:3:0::/64", "2001:db8:4::/120", "2001:db8:5::10/124", "10.0.0.0/8", "10.0.0.0/16", "::ffff:10.1.0.0/112", "2001:db8::/129", "nonsense/8")])).alias("prefix"))
    return joins.prefix_join(own, nets)


# ---- inventories that grow ------------------------------------------------------------------------------------------------


@query("d1_in_batches", SQL["d1_smart"])
def d1_batches(spark: SparkSession, sf: str) -> DataFrame:
    """The merge of ten batches, of which one comes twice."""
    own, merged = assets(spark, sf), growing.MergedAssets(spark, folder(spark))
    for n in (3, 1, 2, 0, 4, 5, 6, 7, 8, 9, 9):
        merged.add(n, own.where(F.pmod("seq", F.lit(10)) == n))
    lists = [F.array_join(c, ",").alias(c) for c in ("products", "cert_domains", "tags")]
    raw = F.array_join(F.transform(F.map_entries("raw"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("raw")
    return merged.result().select("key", "ip", "port", "domain", "host", "url", "service", "title", "org", "update_time", *lists, "source", "group_size", raw)


@query("r9_root_sketches", f"{A} SELECT {ROOT} AS root_domain, count(*) AS assets, true AS subdomains_near, true AS ips_near FROM a WHERE domain IS NOT NULL GROUP BY 1")
def r9_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """Sketches of seven sessions, merged, beside the exact counts: near is within four standard errors."""
    own, counts = assets(spark, sf), growing.RootCounts(spark, folder(spark))
    for n in range(7):
        counts.add(n, own.where(F.pmod("seq", F.lit(7)) == n))
    exact = report.root_domains(own).select("root_domain", F.col("subdomains").alias("d"), F.col("ips").alias("i"))
    near = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 4 * counts.error * F.col(b)
    return counts.result().join(exact, "root_domain").select("root_domain", "assets", near("subdomains", "d").alias("subdomains_near"), near("ips", "i").alias("ips_near"))


# ---- streams ----------------------------------------------------------------------------------------------------------------


@query("w3_cursor_stream", "SELECT event_id, event_type, user_id FROM events WHERE event_id > 90")
def w3_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Behind cursor 90, in two runs of one checkpoint: the log's first half, then all of it, rewritten in one file."""
    at = folder(spark)
    e = table(spark, sf, "events")
    half = (e.agg(F.max("event_id")).first()[0] or 0) // 2
    for rows in (e.where(F.col("event_id") <= half).repartition(3), e.coalesce(1)):
        rows.write.mode("overwrite").parquet(f"{at}/log")
        progress.into(cursor.cursor_stream(spark, f"{at}/log", since=90), f"{at}/taken", f"{at}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{at}/taken").select("event_id", "event_type", "user_id")


@query(
    "w1_outcomes",
    """WITH e AS (SELECT user_id AS source, CASE WHEN event_type IN ('signup', 'click') THEN 'start' WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS phase, ts, event_id FROM events WHERE event_type <> 'view'),
    o AS (SELECT *, lead(ts) OVER w AS next_ts, lead(phase) OVER w AS next_phase, lag(ts) OVER w AS last_ts, lag(phase) OVER w AS last_phase FROM e WINDOW w AS (PARTITION BY source ORDER BY ts, event_id)),
    m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM e), d AS (SELECT *, 43200 AS lim FROM o, m)
    SELECT source, ts AS started, CASE WHEN next_ts IS NULL OR next_ts - ts > lim * INTERVAL 1 SECOND THEN 'timed_out' WHEN next_phase = 'start' THEN 'restarted' ELSE next_phase END AS status,
      CASE WHEN next_ts IS NULL OR next_ts - ts > lim * INTERVAL 1 SECOND THEN CAST(lim AS DOUBLE) ELSE (epoch_us(next_ts) - epoch_us(ts)) / 1e6 END AS seconds
    FROM d WHERE phase = 'start' AND (next_ts IS NOT NULL OR ts + lim * INTERVAL 1 SECOND < mark)
    UNION ALL SELECT source, NULL, 'unmatched', NULL FROM d WHERE phase <> 'start' AND (last_phase IS NULL OR last_phase <> 'start' OR ts - last_ts > lim * INTERVAL 1 SECOND)""",
)
def w1_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that were started, with a deadline of twelve hours. The log is at rest and its files overlap in time, so it is one batch."""
    e = progress.event_stream(spark, f"{sf}/events.parquet", table(spark, sf, "events").schema, files_per_trigger=None)
    phase = F.when(F.col("event_type").isin("signup", "click"), "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed")
    own = e.select(F.col("user_id").alias("source"), phase.alias("phase"), F.col("ts").alias("time"), F.col("event_id").alias("n"))
    return progress.drained(deadlines.outcomes(own, seconds=43_200), folder(spark), "append")


# ---- scripts ------------------------------------------------------------------------------------------------------------------

_LINKS = "list_distinct(regexp_extract_all(html, 'href=\"([^\"<>\\\\]*)\"', 1))"
_ADDRESS = "regexp_full_match(v, '(?:/|\\{var\\})[A-Za-z0-9_\\-./?#=&%~+:{},*]*|https?://[A-Za-z0-9._\\-:]\\S*') AND length(v) BETWEEN 4 AND 1024"


@query(
    "x12_endpoints",
    f"""WITH l AS (SELECT page_id, unnest({_LINKS}) AS v FROM pages), p AS (SELECT page_id, '/p' || (1000 + page_id) AS b FROM pages),
    c AS (SELECT page_id, unnest(['string', 'route']) AS rule, v FROM l UNION SELECT page_id, 'string', b FROM p UNION SELECT page_id, 'string', '/items' FROM p UNION SELECT page_id, 'concat', b || '/items' FROM p UNION SELECT page_id, 'call', b || '/items' FROM p
      UNION SELECT page_id, 'template', '{{var}}/u/{{var}}' FROM p UNION SELECT page_id, 'call', '{{var}}/u/{{var}}' FROM p UNION SELECT page_id, 'template', '/in/{{var}}' FROM p UNION SELECT page_id, 'string', '/tail' FROM p)
    SELECT page_id, rule, trim(v) AS value FROM (SELECT page_id, rule, trim(v) AS v FROM c) WHERE {_ADDRESS}""",
)
def x12_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Scripts with each page's links as routes, a named base that a call joins, templates within templates, an unknown part before a constant."""
    links = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"<>\\\\]*)"'), F.lit(1)))
    routes = F.array_join(F.transform(links, lambda v: F.concat(F.lit('{name: 1, path: "'), v, F.lit('"}'))), ",\n")
    base = F.concat(F.lit("// '/no'\nconst BASE = '/p"), (1000 + F.col("page_id")).cast("string"), F.lit("'\nconst routes = ["))
    tail = F.lit("]; /* \"/no\" */ axios.get(BASE + \"/items\", {q: x.replace(/\"\\/no\\//g, 1)});\nfetch(`${HOST}/u/${f(`/in/${z}`)}`); y = q + '/tail'")
    return table(spark, sf, "pages").select("page_id", F.inline(scripts.script_endpoints(F.concat(base, routes, tail)))).distinct()


# ---- records of crawlers and of scanned ranges, translated queries -------------------------------------------------------------


@query(
    "a6_crawl_records",
    f"""SELECT url, {_HOST_SQL} AS host, 'GET' AS method, 'script' AS tag, CASE WHEN min(page_id) % 2 = 0 THEN '200' ELSE '404' END AS status, 'Nginx' AS products, 'crawler' AS source, min(page_id) AS seq FROM pages WHERE page_id % 5 <> 0 GROUP BY url
    UNION ALL SELECT url || '#form', {_HOST_SQL}, 'POST', 'form', CASE WHEN page_id % 2 = 0 THEN '200' ELSE '404' END, 'Nginx', 'crawler', 100000 + page_id FROM pages WHERE page_id % 5 <> 0""",
)
def a6(spark: SparkSession, sf: str) -> DataFrame:
    """Crawl records as JSON lines, written and read: every page twice by GET, once by POST with a form that names the page, one in five with an error."""
    at, p = folder(spark), table(spark, sf, "pages")
    row = lambda url, method, tag, add: p.select(F.struct(F.lit(method).alias("method"), url.alias("endpoint"), F.lit(tag).alias("tag"), F.when(F.lit(tag) == "form", F.concat(F.lit("page="), "page_id")).alias("body")).alias("request"), F.struct(F.when(F.col("page_id") % 2 == 0, 200).otherwise(404).alias("status_code"), F.array(F.lit("nginx")).alias("technologies")).alias("response"), F.when(F.col("page_id") % 5 == 0, "timeout").alias("error"), (F.col("page_id") + add).alias("seq"))
    rows = row(F.col("url"), "get", "script", 0).union(row(F.concat(F.lit(" "), "url"), "", "body", 50_000)).union(row(F.concat("url", F.lit("#form")), "post", "form", 100_000))
    rows.write.json(at)
    read = spark.read.schema(f"{records.SCHEMAS['crawl']}, seq long").json(at)
    return records.crawl_assets(read).select("url", "host", F.col("raw")["method"].alias("method"), F.col("raw")["tag"].alias("tag"), F.col("raw")["status"].alias("status"), F.array_join("products", ",").alias("products"), "source", "seq")


@query(
    "a14_range_records",
    """WITH p AS (SELECT s_suppkey AS k, '10.9.' || (s_suppkey % 7) || '.' || (s_suppkey % 250) AS host FROM supplier), o AS (SELECT DISTINCT host, CASE WHEN k % 3 = 0 THEN 8443 ELSE 22 END AS port FROM p), h AS (SELECT k, host, 8443 AS port FROM p WHERE k % 3 = 0 OR k % 3 = 1 AND k % 2 = 0)
    SELECT host, CASE WHEN o.host IS NOT NULL THEN host END AS ip, port, CASE WHEN k IS NOT NULL THEN 'https://' || host || ':8443/x' END AS url, CASE WHEN k IS NOT NULL THEN '[Active] ' || host || ' (T' || k || ')' END AS title, CASE WHEN k IS NOT NULL THEN 'Nginx,PHP' ELSE '' END AS products, '10.9.0.0/16' AS cidr, CASE WHEN k IS NOT NULL THEN '200' END AS status
    FROM h FULL JOIN o USING (host, port)""",
)
def a14(spark: SparkSession, sf: str) -> DataFrame:
    """Open ports and HTTP answers of a range, as JSON lines: answers with and without a port that was found open, ports without an answer."""
    at, k = folder(spark), F.col("s_suppkey")
    p = table(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("10.9."), k % 7, F.lit("."), k % 250).alias("host"))
    p.select("host", F.when(k % 3 == 0, 8443).otherwise(22).alias("port")).write.json(f"{at}/ports")
    p.where((k % 3 == 0) | (k % 3 == 1) & (k % 2 == 0)).select("host", F.concat(F.lit("https://"), "host", F.lit(":8443/x")).alias("url"), F.concat(F.lit("T"), k).alias("title"), F.lit(200).alias("status_code"), F.array(F.lit("php"), F.lit("nginx")).alias("technologies")).write.json(f"{at}/http")
    out = records.range_assets(records.read(spark, f"{at}/ports", "range_port"), records.read(spark, f"{at}/http", "range_http"), "10.9.0.0/16")
    return out.select("host", "ip", "port", "url", "title", F.coalesce(F.array_join("products", ","), F.lit("")).alias("products"), F.col("raw")["cidr"].alias("cidr"), F.try_element_at("raw", F.lit("status")).alias("status"))


#: Independent of the library's table: how each engine names the two fields of the queries below.
_NATIVE = (("fofa", "host", "icon_hash"), ("quake", "hostname", "icon_hash"), ("shodan", "hostname", "http.favicon.hash"), ("zoomeye", "hostname", "favicon"), ("hunter", "web.title", "web.icon"), ("zerozone", "host", "favicon"))


@query(
    "c13_translated",
    f"""WITH q AS (SELECT page_id, {_HOST_SQL} AS h FROM pages), n(engine, host, icon) AS (VALUES {", ".join(str(x) for x in _NATIVE)})
    SELECT page_id, engine, host || '="' || h || '" && !(' || icon || '="' || page_id || '" || fofa::is_honeypot="true")' AS native,
      'host="' || h || '" && !(favicon="' || page_id || '" || fofa::is_honeypot="true")' AS common, 'host="' || h || '" && !(favicon="' || page_id || '" || )' AS stripped, 'fofa:is_honeypot:true' AS own FROM q, n WHERE engine IN ('fofa', 'quake', 'shodan', 'zerozone')""",
)
def c13_translated(spark: SparkSession, sf: str) -> DataFrame:
    """A query of each page in the words of four engines, back again, without the terms of one engine, and these terms."""
    host = F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1))
    text = F.concat(F.lit('host="'), host, F.lit('" && !(favicon="'), F.col("page_id").cast("string"), F.lit('" || fofa::is_honeypot="true")'))
    own = table(spark, sf, "pages").select("page_id", text.alias("q"))
    made = own.select("page_id", "q", F.explode(dsl.translations("q")).alias("engine", "native")).where(F.col("engine").isin("fofa", "quake", "shodan", "zerozone"))
    back = F.lit(None).cast("string")
    for e in ("fofa", "quake", "shodan", "zerozone"):
        back = F.when(F.col("engine") == e, dsl.parsed(F.col("native"), e)).otherwise(back)
    terms = F.array_join(F.transform(dsl.exclusive_terms("q"), lambda t: F.concat_ws(":", t["engine"], t["field"], t["value"])), ",")
    return made.select("page_id", "engine", "native", back.alias("common"), dsl.stripped("q").alias("stripped"), terms.alias("own"))
