"""A landed response of every source for each page, and the assets that it must become.

``%n`` stands for the page's id and ``%h`` for its host. Bodies follow the sources' formats; what is expected is written
down beside them, not derived from the connectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.sources import connectors

COLUMNS = ("name", "ip", "port", "title", "url", "org")
_IP = "10.7.0.9"


def _row(name=None, ip=None, port=None, title=None, url=None, org=None) -> tuple:
    """``name``: the host, or else the domain."""
    return name, ip, port, title, url, org


#: source: (body, rows of COLUMNS). The target of a response is ``t%n.example.net``.
_T = "t%n.example.net"
SAMPLES: dict[str, tuple[str, list[tuple]]] = {
    "fofa": ('{"error":false,"results":[["%h","10.7.0.9","443","T%n","%h","DE","Acme","nginx","https"]]}', [_row("%h", _IP, 443, "T%n")]),
    "hunter": ('{"data":{"arr":[{"ip":"10.7.0.9","port":8443,"host":"%h","web":{"title":"T%n","server":"x"},"location":{"country_cn":"DE"},"protocol":"https"}]}}', [_row("%h", _IP, 8443, "T%n")]),
    "quake": ('{"data":[{"ip":"10.7.0.9","port":80,"service":{"name":"%h","title":"T%n"},"location":{"country_cn":"DE"}}]}', [_row("%h", _IP, 80, "T%n")]),
    "shodan": ('{"matches":[{"ip_str":"10.7.0.9","port":22,"hostnames":["%h","b"],"title":"T%n"}]}', [_row("%h", _IP, 22, "T%n")]),
    "shodan_engine": ('{"matches":[{"ip_str":"10.7.0.9","port":22,"hostnames":["%h"]}]}', [_row("%h", _IP, 22)]),
    "zoomeye": ('{"matches":[{"ip":"10.7.0.9","portinfo":{"port":21,"service":"ftp"},"domains":["%h"]}]}', [_row("%h", _IP, 21)]),
    "zoomeye_engine": ('{"matches":[{"ip":"10.7.0.9","portinfo":{"port":21},"domains":["%h"]}]}', [_row("%h", _IP, 21)]),
    "abuseipdb": ('{"data":{"abuseConfidenceScore":%n,"countryCode":"DE","isp":"x"}}', [_row(ip=_T)]),
    "bgp_he": ("10.%n.0.0/16\n\n10.9.0.0/16\n", [_row(title="10.%n.0.0/16"), _row(title="10.9.0.0/16")]),
    "binaryedge": ('{"events":[{"target":{"ip":"10.7.0.9","port":5432,"title":"T%n"}}]}', [_row(_T, _IP, 5432, "T%n")]),
    "censys": ('{"result":{"hits":[{"names":["a%n.%h","b%n.%h"],"issuer_dn":"I","subject_dn":"S"}]}}', [_row("a%n.%h"), _row("b%n.%h")]),
    "certspotter": ('[{"dns_names":["a%n.%h","b%n.%h"]},{"dns_names":["c%n.%h"]}]', [_row("a%n.%h"), _row("b%n.%h"), _row("c%n.%h")]),
    "chaos": ('{"domain":"%h","subdomains":["s%n","t"]}', [_row("s%n"), _row("t")]),
    "chinaz": ("a%n.%h\nb%n.%h\n", [_row("a%n.%h"), _row("b%n.%h")]),
    "ct_log": ('[{"issuer_name":"I","name_value":"a%n.%h\\nb%n.%h","not_before":"x"}]', [_row("a%n.%h"), _row("b%n.%h")]),
    "cve_match": ('{"data":[{"id":"CVE-2024-%n","summary":"x"}],"vulnerabilities":[{"cve":{"id":"CVE-2023-%n"}}]}', [_row(title="CVE-2024-%n"), _row(title="CVE-2023-%n")]),
    "daydaymap": ('{"data":{"list":[{"ip":"10.7.0.9","port":"8080","domain":"%h","url":"https://%h/a","title":"T%n","isp":"Acme"}]}}', [_row("%h", _IP, 8080, "T%n", "https://%h/a", "Acme")]),
    "dnsdumpster": ('{"a":[{"host":"a%n.%h","ips":[{"ip":"10.7.0.9"}]}],"ns":[{"host":"ns.%h","ips":[]}],"mx":[]}', [_row("a%n.%h", _IP), _row("ns.%h")]),
    "greynoise": ('{"classification":"benign","actor":"x"}', [_row(ip=_T)]),
    "hackertarget": ("a%n.%h,10.7.0.9\nb%n.%h, 10.7.0.8\n", [_row("a%n.%h", _IP), _row("b%n.%h", "10.7.0.8")]),
    "internetdb": ('{"ports":[22,443],"hostnames":["%h"]}', [_row(ip=_T, port=22), _row(ip=_T, port=443)]),
    "ipinfo": ('{"country":"DE","city":"Bonn","org":"AS%n Acme"}', [_row(ip=_T, org="AS%n Acme")]),
    "leakix": ('{"Services":[{"ip":"10.7.0.9","port":"27017","software":{"name":"x"}}]}', [_row(_T, _IP, 27017)]),
    "netlas": ('{"items":[{"data":{"ip":"10.7.0.9","port":443,"host":"%h","http":{"title":"T%n"}}}]}', [_row("%h", _IP, 443, "T%n")]),
    "onyphe": ('{"results":[{"ip":"10.7.0.9","port":25,"hostname":["%h"],"organization":"Acme","title":"T%n"}]}', [_row('["%h"]', _IP, 25, "T%n", None, "Acme")]),
    "otx": ('{"passive_dns":[{"hostname":"a%n.%h","address":"10.7.0.9","first":"x"}]}', [_row("a%n.%h", _IP)]),
    "rapiddns": ("a%n.%h\nb%n.%h", [_row("a%n.%h"), _row("b%n.%h")]),
    "securitytrails": ('{"current_dns":{"a":{"values":[{"ip":"10.7.0.9"}]}},"records":[{"values":[{"ip":"10.7.0.8"}],"first_seen":"x"}]}', [_row(_T, _IP), _row(_T, "10.7.0.8")]),
    "threatminer": ('{"results":["a%n.%h","b%n.%h"]}', [_row("a%n.%h"), _row("b%n.%h")]),
    "urlscan": ('{"results":[{"page":{"url":"https://%h/p%n","ip":"10.7.0.9","domain":"%h","title":"T%n"}}]}', [_row("%h", _IP, None, "T%n", "https://%h/p%n")]),
    "virustotal": ('{"positives":%n,"total":70}', [_row(_T)]),
    "whois_reverse": ('{"domainsList":["a%n.example.com","b%n.example.com"]}', [_row("a%n.example.com"), _row("b%n.example.com")]),
    "commoncrawl": ('{"url":"https://%h/c%n"}\n{"url":"https://%h/d%n"}\nno json\n', [_row(None, None, None, "https://%h/c%n", "https://%h/c%n"), _row(None, None, None, "https://%h/d%n", "https://%h/d%n")]),
    "dnslytics": ('{"asn":%n,"country":"DE"}', [_row(ip=_T)]),
    "viewdns": ('{"response":{"domains":[{"name":"a%n.example.com"},{"name":"b%n.example.com"}]}}', [_row("a%n.example.com"), _row("b%n.example.com")]),
    "robtex": ('{"rrname":"a%n.%h","rrdata":"10.7.0.9"}\n{"rrname":"b%n.%h","rrdata":"10.7.0.8"}', [_row("a%n.%h", _IP), _row("b%n.%h", "10.7.0.8")]),
    "ripestat": ('{"data":{"asns":[%n],"prefix":"10.0.0.0/8"}}', [_row(ip=_T)]),
    "rdap": ('{"handle":"H%n","status":["active"]}', [_row(_T)]),
    "publicwww": ("https://%h/w%n\n", [_row(None, None, None, "https://%h/w%n", "https://%h/w%n")]),
    "pulsedive": ('{"risk":"low","threats":[]}', [_row(_T)]),
    "pdns_circl": ('{"rrname":"a%n.%h","rdata":"10.7.0.9"}', [_row("a%n.%h")]),
    "pdns_mnemonic": ('{"data":[{"query":"a%n.%h","answer":"10.7.0.9"}]}', [_row("a%n.%h")]),
    "hunt_io": ('{"classifications":["x"]}', [_row(ip=_T)]),
    "greynoise_community": ('{"classification":"malicious","name":"x"}', [_row(ip=_T)]),
    "github_commits": ('{"items":[{"html_url":"https://example.com/r/%n","repository":{"full_name":"o/r%n"},"commit":{"message":"m"}}]}', [_row(None, None, None, "o/r%n", "https://example.com/r/%n")]),
    "driftnet": ('{"results":[{"host":"a%n.%h","ip":"10.7.0.9"}]}', [_row("a%n.%h", _IP)]),
    "validin": ('{"records":[{"value":"a%n.%h"}]}', [_row("a%n.%h")]),
    "searchengine": ("https://%h/q%n\n", [_row(None, None, None, "https://%h/q%n", "https://%h/q%n")]),
    "shodan_enrich": ('{"data":[{"port":80,"product":"nginx","http":{"title":"T%n"}},{"port":22}]}', [_row(None, _T, 80, "T%n"), _row(None, _T, 22)]),
    "opencorporates": ('{"results":{"companies":[{"company":{"name":"Acme %n","company_number":"%n"}}]}}', [_row(title="Acme %n", org="Acme %n")]),
    "wayback": ('[["original","timestamp"],["https://%h/o%n","2020"],["odd"]]', [_row(url="https://%h/o%n")]),
    "supply_github_org": ('{"name":"Acme %n","html_url":"https://example.com/o%n","description":"D%n","homepage":"https://%h/"}', [_row("%h", None, None, "D%n", "https://example.com/o%n", "Acme %n")]),
    "app_market_search": ('{"RelatedTopics":[{"FirstURL":"https://example.com/app%n","Text":"App %n"}]}', [_row(None, None, None, "App %n", "https://example.com/app%n")]),
    "gitee_code": ("https://example.com/g%n\n", [_row(None, None, None, "https://example.com/g%n", "https://example.com/g%n")]),
    "github_code": ('{"items":[{"html_url":"https://example.com/c%n","path":"a/%n.py","repository":{"full_name":"o/r"}}]}', [_row(None, None, None, "a/%n.py", "https://example.com/c%n")]),
    "bgpview": ('{"data":{"asns":[{"asn":%n,"name":"Acme","country_code":"DE"}],"prefixes":[{"prefix":"10.0.0.0/8","name":"Globex"}]}}', [_row(org="Acme"), _row(org="Globex")]),
    "asn_recon": ('{"results":[["%h","10.7.0.9","443","T%n"],{"host":"a%n.%h","ip":"10.7.0.8"}]}', [_row("%h", _IP, 443, "T%n"), _row("a%n.%h", "10.7.0.8")]),
    "fullhunt": ('{"hosts":[{"host":"a%n.%h","ip":"10.7.0.9","port":443}]}', [_row("a%n.%h", _IP, 443)]),
    "maltiverse": ('{"malicious":true,"description":"x"}', [_row(_T)]),
    "zerozone": ('{"data":[{"msg":{"ip":"10.7.0.9"},"root_domain":"%h","url":"https://%h/z%n","group":"Acme","beian":"ICP%n"}]}', [_row("%h", _IP, None, None, "https://%h/z%n", "Acme")]),
    "abusech": ("# addresses\n10.7.0.9\nt%n.example.net\n", [_row(ip=_T, title=_T)]),
    "abusech_urlhaus": ("# addresses\nhttps://t%n.example.net/x\nhttps://%h/y\n", [_row(None, None, None, "https://t%n.example.net/x", "https://t%n.example.net/x")]),
    "bdziyi_fofa": ('{"error":false,"results":[["https://%h/f%n","10.7.0.9","T%n","443","","HTTPS"]]}', [_row("%h", _IP, 443, "T%n", "https://%h/f%n")]),
    "bdziyi_icp": ('{"result":[{"domain":"a%n.example.com","unitName":"Acme","mainLicence":"ICP%n","updateRecordTime":"2024"},{"unitName":"Globex"}]}', [_row("a%n.example.com", None, None, "Acme", None, "Acme"), _row(_T, None, None, "Globex", None, "Globex")]),
    "bdziyi_ze": ('{"data":[{"ip":"10.7.0.9","port":8443,"domain":"a%n.%h","title":["T%n"],"organization":{"name":"x"}}]}', [_row("a%n.%h", _IP, 8443, "T%n")]),
    "beianx": ("<table><tr><th>n</th></tr><tr class='x'><td>1</td><td> <b>Acme</b> </td><td>x</td><td>ICP%n</td><td>T%n</td><td><a href='y'>a%n.example.com</a></td><td>2024</td></tr></table>", [_row("a%n.example.com", None, None, "T%n", None, "Acme")]),
    "company_structure_api": ('{"enterprise_info":[{"name":"Acme","website":"https://www.%h/"}],"icp_info":[{"domain":"a%n.example.com","icp_num":"ICP%n"}],"app_info":[{"name":"App %n","platform":"x"}]}', [_row("www.%h", None, None, "Acme"), _row("a%n.example.com", None, None, "a%n.example.com"), _row(title="App %n")]),
    "zerozone_extra": ('{"data":{"list":[{"domain":"a%n.%h","url":"https://%h/e%n","title":"T%n","company":"Acme"}]}}', [_row("a%n.%h", None, None, "T%n", "https://%h/e%n", "Acme")]),
}


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, body, seq): a response of each source for each page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").cast("string").alias("n"), F.col("page_id").alias("seq"), F.lower(F.regexp_extract("url", "://([^/?#:]+)", 1)).alias("h"))
    samples = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(body).alias("body")) for s, (body, _) in SAMPLES.items()])
    # a page becomes a response of each source: pages are dealt over all cores first, few though the table's row groups may be
    each = pages.repartition(4 * spark.sparkContext.defaultParallelism).select("*", F.inline(samples))
    of = lambda c: F.replace(F.replace(c, F.lit("%n"), F.col("n")), F.lit("%h"), F.col("h"))
    return each.select("source", of(F.lit(_T)).alias("target"), of(F.col("body")).alias("body"), "seq")


def expected_sql() -> str:
    literal = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({', '.join(literal(x) for x in (s, *r))})" for s, (_, found) in SAMPLES.items() for r in found)
    of = lambda c: f"CAST(port AS INT) AS port" if c == "port" else f"replace(replace({c}, '%n', n), '%h', h) AS {c}"  # noqa: E731, F541
    return (
        f"SELECT source, seq, {', '.join(of(c) for c in COLUMNS)} FROM (SELECT CAST(page_id AS VARCHAR) AS n, page_id AS seq, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS h FROM pages) "
        f"CROSS JOIN (VALUES {rows}) AS v(source, {', '.join(COLUMNS)})"
    )


def read_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return connectors.ingest(landed(spark, sf_dir), SAMPLES).select("source", "seq", F.coalesce("host", "domain").alias("name"), *COLUMNS[1:])
