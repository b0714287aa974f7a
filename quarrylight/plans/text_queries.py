"""Queries of the rules over texts, pages and scripts, with SQL that runs every rule.

The rules' own patterns are used on both sides (a rule is its pattern); what is done with the matches is written anew in
SQL. Texts get a sample for each rule, so that each one has something to find.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import functions as F

from quarrylight.functions import text, web
from quarrylight.plans.registry import query, table


def _pattern(p: str) -> str:
    """A rule's pattern for DuckDB, whose word boundaries are those of ASCII."""
    return p.replace(text._B, r"\b").replace(text._E, r"\b").replace("'", "''")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sample(key: str, samples: Sequence[str]) -> str:
    """One of ``samples`` by ``key``, in SQL of both engines."""
    return f"CASE {key} % {len(samples) + 1} " + " ".join(f"WHEN {i} THEN {_quoted(s)}" for i, s in enumerate(samples)) + " ELSE '' END"


# ---- personal data -----------------------------------------------------------------------------------------------

PERSONAL = (
    " 手机 13800138000 end", " SSN 123-45-6789", " ip 192.168.1.20.", " mac 00:1A:2B:3C:4D:5E", " mac 00-1A-2B-3C-4D-5E", " id 110101199003078515 ", " old 110101900307851 ",
    " card 4111111111111111, 4111111111111112", " plate 京A12345 ", " passport G12345678 ", " QQ号: 123456789 ", " wechat: ab_cdef12 ", " code 91350211M000100Y43 ",
    " iban DE89370400440532013000 ", " mail ab@example.com, long.name@example.com ",
)
_DIGIT = "CAST(v[i] AS INT)"
_LUHN = f"list_sum(list_transform(range(1, length(v) + 1), lambda i: CASE WHEN (length(v) - i) % 2 = 0 THEN {_DIGIT} WHEN {_DIGIT} > 4 THEN {_DIGIT} * 2 - 9 ELSE {_DIGIT} * 2 END)) % 10 = 0"


def _matches_sql(rules: Sequence[text.Rule]) -> str:
    """doc_id, label, severity, v of table d (doc_id, t)."""
    of = [f"SELECT doc_id, '{r.label}' AS label, '{r.severity}' AS severity, unnest(regexp_extract_all(t, '{_pattern(r.pattern)}')) AS v FROM d" for r in rules]
    checked = ", ".join(f"'{r.label}'" for r in rules if r.luhn) or "''"
    return f"SELECT * FROM ({' UNION ALL '.join(of)}) WHERE label NOT IN ({checked}) OR {_LUHN}"


_REDACTED = """CASE WHEN label = 'phone_cn' AND length(v) = 11 THEN left(v, 3) || '****' || right(v, 4)
  WHEN label LIKE 'idcard%' THEN left(v, 6) || '********' || right(v, 4) WHEN label = 'bankcard_luhn' OR label = 'iban' THEN left(v, 4) || '****' || right(v, 4)
  WHEN label IN ('email', 'general') THEN CASE WHEN strpos(v, '@') > 4 THEN left(v, 2) || '***' ELSE left(v, strpos(v, '@') - 1) END || substring(v, strpos(v, '@'))
  WHEN label = 'mac' AND contains(v, ':') THEN left(v, 8) || ':**:**' WHEN label = 'ipv4_private' THEN regexp_extract(v, '^\\d+\\.\\d+') || '.**.**'
  WHEN label IN ('qq', 'wechat') THEN left(v, 2) || '***' WHEN label = 'social_credit_code_cn' THEN left(v, 6) || '********' || right(v, 4)
  WHEN label = 'us_ssn' THEN left(v, 3) || '-**-****' WHEN label = 'passport_cn' THEN left(v, 4) || '****' ELSE left(v, 2) || '****' END"""
_PERSONAL = f"text || {_sample('doc_id', PERSONAL)}"
_PERSONAL_SQL = f"WITH d AS (SELECT doc_id, {_PERSONAL} AS t FROM documents), m AS ({_matches_sql(text.PII_RULES)})"


@query("t1_pii_counts", f"{_PERSONAL_SQL} SELECT label, count(*) AS n, count(DISTINCT doc_id) AS docs FROM m GROUP BY label")
def t1(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(_PERSONAL).alias("t"))
    return text.scan(d, "t", keep=("doc_id",)).groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@query("t1_t3_pii_redacted", f"{_PERSONAL_SQL} SELECT doc_id, label, severity, {_REDACTED} AS redacted FROM m")
def t1_all(spark, sf):
    return text.scan(table(spark, sf, "documents").select("doc_id", F.expr(_PERSONAL).alias("t")), "t", keep=("doc_id",))


_MAILS = f"text || {_sample('doc_id', [f' {w}: a{i}@example.com ' for i, w in enumerate(('support', 'HR', 'sales', 'admin', 'security', 'finance', 'legal', 'press', 'dev', '客服'))])}"


@query("t5_email_rules", f"WITH d AS (SELECT doc_id, {_MAILS} AS t FROM documents), m AS ({_matches_sql(text.EMAIL_RULES)}) SELECT label, severity, count(*) AS n FROM m GROUP BY ALL")
def t5(spark, sf):
    d = table(spark, sf, "documents").select(F.expr(_MAILS).alias("t"))
    return text.scan(d, "t", text.EMAIL_RULES).groupBy("label", "severity").agg(F.count("*").alias("n"))


_SIX = "text || CASE doc_id % 6 WHEN 0 THEN ' 2001:db8:0:0:0:0:0:1 ' WHEN 1 THEN ' fe80::1 ' WHEN 2 THEN ' fd00::12 and ::1 ' WHEN 3 THEN ' ff02::1 ' ELSE '' END"


@query("t4_ipv6", f"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all({_SIX}, {_quoted(text.IPV6)})) AS ip FROM documents), p AS (SELECT *, string_split(ip, ':') AS g FROM m)
SELECT doc_id, CASE WHEN lower(ip) LIKE 'fe80%' THEN 'ipv6_linklocal' WHEN lower(ip) LIKE 'fd%' THEN 'ipv6_ula' WHEN ip = '::1' THEN 'ipv6_loopback' WHEN length(g[1]) = 4 AND g[1][1] IN ('2', '3') THEN 'ipv6_public' ELSE 'ipv6_other' END AS label,
  CASE WHEN len(g) >= 4 THEN array_to_string(g[1:3], ':') || ':...:' || array_to_string(g[len(g) - 1:], ':') WHEN length(ip) > 12 THEN left(ip, 12) || '...' ELSE ip END AS redacted FROM p""")  # fmt: skip
def t4(spark, sf):
    return text.scan_ipv6(table(spark, sf, "documents").select("doc_id", F.expr(_SIX).alias("t")), "t", ("doc_id",))


_CONTACTS = "html || CASE page_id % 4 WHEN 0 THEN ' 13800138000 +86 13800138000 010-12345678' WHEN 1 THEN ' 京ICP备12345678号-1 京icp备12345678号-1' WHEN 2 THEN ' Info@Example.com info@example.com' ELSE '' END"


def _first_spellings(pattern: str) -> str:
    return f"array_to_string(list_sort(list_transform(list_distinct(list_transform(regexp_extract_all(h, {_quoted(pattern)}), lambda x: lower(trim(x)))), lambda y: list_filter(list_transform(regexp_extract_all(h, {_quoted(pattern)}), lambda z: trim(z)), lambda z: lower(z) = y)[1])), ',')"


@query("t6_contacts", f"SELECT page_id, {_first_spellings(text.HTML_MAIL)} AS emails, {_first_spellings(text.PHONE)} AS phones, {_first_spellings(text.ICP)} AS icp_numbers FROM (SELECT page_id, {_CONTACTS} AS h FROM pages)")
def t6(spark, sf):
    c = text.contacts(F.col("h"))
    return table(spark, sf, "pages").select("page_id", F.expr(_CONTACTS).alias("h")).select("page_id", *[F.array_join(c[k], ",").alias(k) for k in ("emails", "phones", "icp_numbers")])


_TRACKED = _sample("page_id", ["<script>G-ABCDEFGH12</script>", "x UA-12345-7 y GTM-ABC1234", "//hm.baidu.com/hm.js?0123456789abcdef01234567", "https://s13.cnzz.com/z_stat.php?id=12345", "https://s1.cnzz.com/c.php?99"])
_CERTIFICATE = _sample("page_id", ["Subject:\n    Organization: Acme Inc.\n    Common Name: a\nIssuer: O=DigiCert Inc", "CN=b,O=Globex,C=US", "C=US, O=Amazon, CN=c"])


@query("t7_trackers", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'G-ABCDEFGH12' WHEN 1 THEN 'GTM-ABC1234,UA-12345-7' WHEN 2 THEN 'hm.js?0123456789abcdef01234567' WHEN 3 THEN 'cnzz-12345' WHEN 4 THEN 'cnzz-99' ELSE '' END AS ids, CASE page_id % 4 WHEN 0 THEN 'Acme Inc.' WHEN 1 THEN 'Globex' ELSE '' END AS orgs FROM pages")
def t7(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.array_join(text.trackers(F.expr(_TRACKED)), ",").alias("ids"), F.array_join(text.certificate_orgs(F.expr(_CERTIFICATE)), ",").alias("orgs"))


@query("t8_t9_t10_script_strings", """SELECT page_id, '[{"type":"api","url":"/api/items/' || page_id || '"},{"type":"websocket","url":"wss://h/ws"}]' AS endpoints, 'a.ts,b.ts' AS sources,
  regexp_replace(regexp_replace(url, '[?#].*$', ''), '\\.js$', '') || '.js.map' AS map_url, '[{"link":"u' || page_id || '","title":"T' || page_id || '"},{"link":"v","title":"w"}]' AS results FROM pages""")  # fmt: skip
def t8(spark, sf):
    n = F.col("page_id").cast("string")
    body = F.concat(F.lit("fetch('/api/items/"), n, F.lit("'); new WebSocket(\"wss://h/ws\"); {\"sources\": [\"a.ts\", \"b.ts\"]}"))
    found = F.concat(F.lit("<a href='u"), n, F.lit("'><b>T"), n, F.lit("</b></a><a href='v'><b>w</b></a>"))
    return table(spark, sf, "pages").select(
        "page_id", F.to_json(text.script_endpoints(body)).alias("endpoints"), F.array_join(text.source_map_files(body), ",").alias("sources"), text.source_map_url(F.col("url")).alias("map_url"),
        F.to_json(text.scraped(found, "href='([^']*)'", "<b>([^<]*)</b>")).alias("results"),
    )


# ---- pages and scripts -------------------------------------------------------------------------------------------


def _nth(values: Sequence[str], key: str = "page_id") -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {_quoted(v)}" for i, v in enumerate(values)) + " END"


_HEADER = _nth([h for _, place, h in web.PRODUCTS if place == 'header'])
_BODY = f"html || ' ' || {_nth([b for _, place, b in web.PRODUCTS if place == "body"])}"
_COOKIE = _nth([c for _, place, c in web.PRODUCTS if place == 'cookie'])
_ICON = _nth([f for _, place, f in web.PRODUCTS if place == 'favicon'])


def _products_sql() -> str:
    rows = []
    for r in web.FINGERPRINTS:
        name, _, value = r.header.lower().partition(":")
        rows.append(f"({', '.join(_quoted(x) for x in (web.ALIASES.get(r.product.lower(), r.product), f'{name}:' if name else '', value.strip(), r.body.lower(), r.cookie.lower(), r.favicon))})")
    return f"""WITH p AS (SELECT page_id, lower({_HEADER}) AS line, 'cookie: x=1; ' || lower({_COOKIE}) AS cookies, lower({_BODY}) AS b, {_ICON} AS icon FROM pages),
  r(product, header, value, body, cookie, favicon) AS (VALUES {', '.join(rows)}),
  f AS (SELECT page_id, product FROM p CROSS JOIN r WHERE CASE WHEN header <> '' THEN starts_with(line, header) AND contains(line, value) OR starts_with(cookies, header) AND contains(cookies, value) WHEN body <> '' THEN contains(b, body) WHEN cookie <> '' THEN contains(cookies, cookie) OR starts_with(line, 'set-cookie:') AND contains(line, cookie) ELSE icon = favicon END)
SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(list(product) FILTER (WHERE product IS NOT NULL))), ','), '') AS products FROM p LEFT JOIN f USING (page_id) GROUP BY page_id"""


@query("x1_products", _products_sql())
@query("x1_products_all_rules", _products_sql())
def x1_all(spark, sf):
    name = lambda c: F.regexp_extract(c, "^([^:]*)", 1)
    p = table(spark, sf, "pages").select("page_id", F.expr(_HEADER).alias("line"), F.expr(_COOKIE).alias("cookie"), F.expr(_BODY).alias("b"), F.expr(_ICON).alias("icon"))
    headers = F.create_map(name(F.col("line")), F.trim(F.regexp_replace("line", "^[^:]*:", "")), F.lit("Cookie"), F.concat(F.lit("x=1; "), "cookie"))
    return p.select("page_id", F.array_join(web.products(headers, F.col("b"), F.col("icon")), ",").alias("products"))


_Z = "Z" * 60
#: Strings of the rules' forms, all of one letter.
SCRIPTS = (
    " '/api/v1/x' ", f" AKIA{_Z[:16]} ", f" aws_secret_access_key='{_Z[:40]}' ", f" LTAI{_Z[:18]} ", f" AKID{_Z[:36]} ", f" AIza{_Z[:35]} ", f" 123-{_Z[:32]}.apps.googleusercontent.com ",
    f" DefaultEndpointsProtocol=https;AccountName=a;AccountKey={_Z[:50]} ", f" ghp_{_Z[:36]} ", f" glpat-{_Z[:24]} ", f" xoxb-{_Z[:24]} ", f" https://hooks.slack.com/services/T{_Z[:9]}/B{_Z[:9]}/{_Z[:24]} ",
    f" 'Bearer {_Z[:30]}' ", f" eyJ{_Z[:10]}.eyJ{_Z[:10]}.{_Z[:10]} ", f" sk_live_{_Z[:24]} ", f" pk_live_{_Z[:24]} ", f" AC{_Z[:32].lower()} ", f" SG.{_Z[:22]}.{_Z[:43]} ", " -----BEGIN RSA PRIVATE KEY----- ",
    f" api_key: '{_Z[:30]}' ", " //# sourceMappingURL=a/b.js.map ",
)
_SCRIPT = f"html || ' ' || url || {_sample('page_id', SCRIPTS)}"


def _findings_sql() -> str:
    of = [f"SELECT page_id, '{r.kind}' AS type, '{r.name}' AS rule, '{r.severity}' AS severity, {r.least} AS least, trim(unnest(regexp_extract_all(s, '{_pattern(r.pattern)}', {r.group}))) AS v FROM d" for r in web.SCRIPT_RULES]
    return f"WITH d AS (SELECT page_id, {_SCRIPT} AS s FROM pages) SELECT DISTINCT page_id, type, rule, severity, CASE WHEN type = 'secret' AND length(v) >= 12 THEN left(v, 4) || repeat('*', length(v) - 8) || right(v, 4) ELSE v END AS value FROM ({' UNION ALL '.join(of)}) WHERE length(v) >= least"


@query("x7_all_rules", _findings_sql())
def x7_all(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.inline(web.script_findings(F.expr(_SCRIPT))))


@query("x7_x8_script_findings", f"SELECT page_id, rule, count(*) AS n FROM ({_findings_sql()}) GROUP BY ALL")
def x7(spark, sf):
    return x7_all(spark, sf).groupBy("page_id", "rule").agg(F.count("*").alias("n"))


@query("x12_script_paths", "SELECT page_id, '/api/v1/' || page_id || ',/u/{var}/posts' AS paths FROM pages")
def x12(spark, sf):
    source = F.concat(F.lit("const u = '/api' + '/v1/"), F.col("page_id").cast("string"), F.lit("'; fetch(`/u/${id}/posts`);"))
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(web.script_paths(source)), ",").alias("paths"))



# ---- icon hashes -------------------------------------------------------------------------------------------------


def _rotated(x: str, r: int) -> str:
    return f"(({x}) * {1 << r} % 4294967296 + ({x}) // {1 << (32 - r)})"


def _times(x: str, factor: int) -> str:
    return f"(({x}) * {factor} % 4294967296)"


def _murmur_sql() -> str:
    """MurmurHash3 (x86, 32 bit) of the Base64 text in lines of 76, block by block."""
    block = lambda i: f"(coalesce(b[{i}], 0) + 256 * coalesce(b[{i} + 1], 0) + 65536 * coalesce(b[{i} + 2], 0) + 16777216 * coalesce(b[{i} + 3], 0))"
    mixed = lambda x: _times(_rotated(_times(x, 0xCC9E2D51), 15), 0x1B873593)
    shifted = lambda x, r: f"xor({x}, {x} // {1 << r})"
    return f"""WITH w AS (SELECT page_id, regexp_replace(base64(encode(html)), '(.{{1,76}})', '\\1' || chr(10), 'g') AS t FROM pages),
  y AS (SELECT page_id, length(t) AS n, list_transform(range(1, length(t) + 1), lambda i: CAST(ascii(t[i]) AS HUGEINT)) AS b FROM w),
  k AS (SELECT page_id, n, list_transform(range(1, n // 4 * 4 + 1, 4), lambda i: {mixed(block('i'))}) AS ks, CASE WHEN n % 4 = 0 THEN CAST(0 AS HUGEINT) ELSE {mixed(block('(n // 4 * 4 + 1)'))} END AS tail FROM y),
  h AS (SELECT page_id, n, xor(xor(list_reduce(list_concat([CAST(0 AS HUGEINT)], ks), lambda h, x: ({_rotated('xor(h, x)', 13)} * 5 + 3864292196) % 4294967296), tail), CAST(n AS HUGEINT)) AS h FROM k),
  i AS (SELECT page_id, {_times(shifted('h', 16), 0x85EBCA6B)} AS h FROM h), j AS (SELECT page_id, {_times(shifted('h', 13), 0xC2B2AE35)} AS h FROM i), l AS (SELECT page_id, {shifted('h', 16)} AS h FROM j)
SELECT page_id, CAST(CASE WHEN h > 2147483647 THEN h - 4294967296 ELSE h END AS {{kind}}) AS icon_hash FROM l"""


@query("x2_favicon_hash", _murmur_sql().replace("{kind}", "INTEGER"))
def x2(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.favicon_hash(F.col("html").cast("binary")).alias("icon_hash"))


# ---- vendors, TXT records, hosting services ------------------------------------------------------------------------

_VALUES = lambda rows: ", ".join("(" + ", ".join(_quoted(x) for x in r) + ")" for r in rows)
_NAME_PARTS = list(web.VENDOR_NAMES)
_HEADER_NAME, _HEADER_VALUE = _nth([n.title() for _, _, n, _ in web.VENDOR_HEADERS]), _nth([f"X {p.upper()} 1" for _, _, _, p in web.VENDOR_HEADERS])
_CNAME = _nth([f"A.{p}.example" for _, _, p in _NAME_PARTS])


@query("x14_vendors", f"""WITH p AS (SELECT page_id, lower({_HEADER_NAME}) AS n, lower({_HEADER_VALUE}) AS v, CASE WHEN page_id % 5 = 0 THEN '' ELSE lower({_CNAME}) END AS c FROM pages),
  f AS (SELECT page_id, vendor, kind, 'header' AS source FROM p JOIN (VALUES {_VALUES(web.VENDOR_HEADERS)}) AS r(vendor, kind, name, part) ON n = name AND contains(v, part)
    UNION SELECT page_id, vendor, kind, 'cname' FROM p JOIN (VALUES {_VALUES(_NAME_PARTS)}) AS r(vendor, kind, part) ON contains(c, part))
SELECT page_id, coalesce(string_agg(vendor || ':' || source, ',' ORDER BY vendor || ':' || source), '') AS vendors, coalesce(bool_or(kind IN ('cdn', 'waf')), false) AS cdn FROM p LEFT JOIN f USING (page_id) GROUP BY page_id""")  # fmt: skip
def x14(spark, sf):
    names = F.when(F.col("page_id") % 5 != 0, F.array(F.expr(_CNAME)))
    hits = web.vendor_hits(F.create_map(F.expr(_HEADER_NAME), F.expr(_HEADER_VALUE)), names)
    return table(spark, sf, "pages").select("page_id", F.array_join(F.array_sort(F.transform(hits, lambda h: F.concat(h["vendor"], F.lit(":"), h["source"]))), ",").alias("vendors"), web.has_cdn(hits).alias("cdn"))


_TXT = _nth([f"{part.upper() if i % 2 else part}{7 + i}{'x y' if i % 3 else ''}" for i, (_, _, part, _) in enumerate(web.TXT_RULES)], "c_custkey")


@query("x5_txt_tokens", f"""WITH t AS (SELECT c_custkey, {_TXT} AS t FROM customer)
SELECT c_custkey, provider, type, value FROM ({" UNION ALL ".join(f"SELECT c_custkey, {_quoted(a)} AS provider, {_quoted(b)} AS type, {f'regexp_extract(t, {_quoted(_pattern(d).replace(chr(39) * 2, chr(39)))}, 1)' if d else "''"} AS value FROM t WHERE contains(lower(t), {_quoted(c)})" for a, b, c, d in web.TXT_RULES)})""")  # fmt: skip
def x5(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.inline(web.txt_tokens(F.expr(_TXT))))


_HOSTED = _nth([f"X.{p}" for _, p in web.HOSTED_NAMES] + ["z.example.org"])


@query("a4_hosted_names", f"SELECT page_id, CASE {' '.join(f'WHEN contains(c, {_quoted(p)}) THEN {_quoted(s)}' for s, p in web.HOSTED_NAMES)} END AS service FROM (SELECT page_id, lower({_HOSTED}) AS c FROM pages)")
def a4(spark, sf):
    return table(spark, sf, "pages").select("page_id", web.hosted_service(F.expr(_HOSTED)).alias("service"))
