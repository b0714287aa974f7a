"""Classifiers of targets, URLs, hosts, parameters and assets, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a URL's lower-case path must contain, by label; the first label that matches counts.
PATHS = {
    "secret": r"/\.(?:git|svn|hg|bzr)(?:/|$)|/\.env(?:\.|/|$)|/\.ds_store$|/wp-config\.php|/web\.config|/config\.php|/configuration\.php|/database\.yml|/secrets\.yml|/id_rsa(?:\.pub)?$|/\.htpasswd|/\.htaccess|\.bak$|\.sql(?:\.gz|\.bz2|\.zip)?$|\.tar(?:\.gz|\.bz2)?$|\.zip$|\.rar$|\.7z$",
    "admin": r"/(?:admin|manager|manage|console|dashboard|jenkins|grafana|phpmyadmin|kibana|zabbix)(?:/|$)",
    "api": r"/(?:api|v\d+|graphql|rest)(?:/|$)|/swagger|/openapi",
    "upload": r"/(?:upload|file|download|attachment)(?:/|$)",
    "debug": r"/(?:test|debug)(?:/|$)|/phpinfo|/server-status|/server-info|/info\.php",
    "auth": r"/(?:oauth|sso|saml|\.well-known|login|signin)(?:/|$)",
    "cve_prone": r"/(?:struts|actuator|druid|elasticsearch|solr|redis|zookeeper)(?:/|$)",
}
# Names of query parameters by kind.
PARAMETERS = {
    "sqli": ("id", "user", "uid", "pid", "product", "item", "cat", "category", "type", "order", "sort", "page", "num", "limit", "count"),
    "ssrf": ("url", "uri", "link", "src", "callback", "target", "return", "redirect", "next", "continue", "dest", "destination", "host", "domain", "fetch", "proxy", "via", "origin"),
    "lfi": ("file", "filename", "path", "dir", "folder", "template", "page", "include", "require", "load", "read", "view", "doc", "document", "attachment"),
    "rce": ("cmd", "exec", "command", "run", "action", "do", "shell", "code", "eval", "func", "method", "operation", "task", "process"),
    "xss": ("q", "search", "query", "keyword", "kw", "s", "term", "text", "content", "message", "msg", "comment", "name", "title", "description", "desc"),
    "auth": ("token", "jwt", "session", "sid", "sess", "auth", "key", "api_key", "apikey", "access_token", "secret", "password", "pwd", "hash", "sign", "signature"),
    "ssti": ("template", "view", "tpl", "theme", "layout", "render", "format"),
    "xxe": ("xml", "data", "payload", "input", "body"),
    "openredir": ("redirect", "redir", "url", "next", "return", "returnto", "return_to", "continue", "forward", "goto", "to", "target"),
}
# Fixed values of the tagger.
CDN_WORDS = ("cloudflare", "cloudfront", "akamai", "fastly", "incapsula", "cdn", "qcloud-cdn", "alikunlun", "ksyuncdn", "wscloudcdn", "chinanetcenter", "wangsu", "baidubce", "azureedge", "edgecast", "stackpath", "sucuri")
PORTS = {
    21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 110: "POP3", 135: "RPC", 139: "NetBIOS", 445: "SMB", 1433: "MSSQL", 1521: "Oracle", 2375: "Docker-API",
    2379: "etcd", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 5601: "Kibana", 5900: "VNC", 6379: "Redis", 7001: "WebLogic", 8009: "AJP", 8080: "HTTP-Alt",
    8161: "ActiveMQ", 8443: "HTTPS-Alt", 8888: "HTTP-Alt", 9000: "PHP-FPM", 9090: "Prom", 9200: "Elasticsearch", 9300: "ES-Cluster", 11211: "Memcached",
    27017: "MongoDB", 50070: "Hadoop",
}
# Words of login pages.
LOGIN_WORDS = ("login", "登录", "signin", "sign in", "管理后台", "后台管理", "admin", "console")
ADMIN_PATHS = ("/admin", "/manage", "/manager", "/console", "/dashboard")
# Words and endings of company names, and endings under which names are registered.
COMPANY_WORDS = ("co., ltd", "co.,ltd", "inc.", "inc ", "llc", "ltd.", "corp", "company", "group")
COMPANY_SUFFIXES = ("公司", "集团", "股份", "有限", "Inc", "Corp", "Ltd", "LLC", "GmbH")
#: Suffixes of two labels under which names are registered; a fuller list may be given.
SUFFIXES = ("com.cn", "net.cn", "org.cn", "edu.cn", "gov.cn", "co.uk", "ac.uk", "org.uk", "gov.uk", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def url_tags(path: Column) -> Column:
    """'high-value' and the label of a path, 'ext:' too for the first label; null if none matches."""
    low = F.lower(path)
    ext = F.regexp_extract(low, r"(\.[^./]*)$", 1)
    out = F.lit(None).cast("array<string>")
    for label, pattern in reversed(PATHS.items()):
        tags = F.array(F.lit("high-value"), F.lit(label))
        if label == "secret":
            tags = F.when(ext != "", F.concat(tags, F.array(F.concat(F.lit("ext:"), ext)))).otherwise(tags)
        out = F.when(low.rlike(pattern), tags).otherwise(out)
    return out


def root_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The registrable domain: a label more than the suffix. One label or none: the host itself."""
    h = F.regexp_replace(F.lower(host), r":\d+$|\.$", "")
    parts = F.split(h, r"\.")
    n = F.size(parts)
    last2 = F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), ".")
    last3 = F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), F.lit(3)), ".")
    return F.when(n <= 2, h).when(last2.isin(*suffixes), last3).otherwise(last2)


def with_public_suffix_root(hosts: DataFrame, suffixes: DataFrame, host: str = "host") -> DataFrame:
    """``hosts`` with ``root`` by a table ``suffixes`` (suffix) in the public suffix format: names, ``*.`` wildcards, ``!`` exceptions.

    Distinct hosts only; each offers its own endings to an equi-join, and the longest rule wins. Spark broadcasts the
    table if it is small.
    """
    names = hosts.select(F.lower(host).alias("_h")).where("_h IS NOT NULL").distinct()
    parts = F.split("_h", r"\.")
    ends = names.select("_h", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("at", "end"))
    rules = suffixes.select(F.lower(F.regexp_replace("suffix", r"^[!*]\.?", "")).alias("end"), F.col("suffix").startswith("*").cast("int").alias("wild"), F.col("suffix").startswith("!").cast("int").alias("but"))
    hit = ends.join(rules, "end").select("_h", F.when(F.col("but") == 1, F.col("at")).otherwise(F.col("at") - 1 - F.col("wild")).alias("start"), "but")
    best = hit.groupBy("_h").agg(F.min(F.struct((-F.col("but")).alias("o"), "start")).alias("b")).select("_h", F.col("b.start").alias("start"))
    n = F.size(parts)
    start = F.coalesce(F.when(F.col("start") >= 0, F.col("start")), n - 2)
    found = names.join(best, "_h", "left").select("_h", F.when(n >= 2, F.array_join(F.slice(parts, F.greatest(start, F.lit(0)) + 1, n), ".")).alias("root"))
    return hosts.join(found, F.lower(hosts[host]) == found["_h"], "left").drop("_h")


def base_name(target: Column) -> Column:
    """The name that a target's resources are usually called by: the label before the registrable suffix."""
    t = F.trim(F.lower(target))
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^https?://", ""), r"[/?#:].*$", ""), r"^\.+|\.+$", "")
    return F.when(t.contains("."), F.regexp_extract(root_domain(t), r"^([^.]*)", 1)).otherwise(t)


def parameter_kinds(name: Column) -> Column:
    low = F.lower(name)
    return F.array_compact(F.array(*[F.when(low.isin(*names), F.lit(kind)) for kind, names in PARAMETERS.items()]))


def asset_tags() -> Column:
    """An asset's tags with those of the offline rules, sorted."""
    text = lambda c: F.coalesce(c, F.lit(""))
    blob = F.lower(F.concat_ws(" ", text(F.col("org")), text(F.col("isp")), text(F.try_element_at("raw", F.lit("cname"))), text(F.col("server"))))
    has = lambda c, words: F.coalesce(c.rlike("|".join(w.replace(".", r"\.") for w in words)), F.lit(False))
    port = F.element_at(F.create_map(*[F.lit(x) for pair in PORTS.items() for x in pair]), F.coalesce("port", F.lit(0)))
    new = F.array_compact(
        F.array(
            F.when(has(blob, CDN_WORDS), F.lit("CDN")),
            F.concat(F.lit("敏感端口:"), port),
            F.when(has(F.lower("title"), LOGIN_WORDS), F.lit("登录入口")),
            F.when(has(F.lower("url"), ADMIN_PATHS), F.lit("后台路径")),
            F.when(F.col("icp").isNotNull(), F.lit("有ICP备案")),
            F.when(F.coalesce(F.exists("cert_domains", lambda d: d.startswith("*.")), F.lit(False)), F.lit("泛域名证书")),
        )
    )
    return F.array_sort(F.array_union(F.coalesce("tags", F.array().cast("array<string>")), new))


# ---- targets -----------------------------------------------------------------------------------------------------


def ipv4_number(c: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""
    p = F.split(c, r"\.")
    n = lambda i: p[i].cast("long")
    return F.when(c.rlike(rf"^{_IPV4}$"), n(0) * 16777216 + n(1) * 65536 + n(2) * 256 + n(3))


def ipv4_text(n: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.shiftright(n, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)])


def ip_range(target: Column, most: int = 4096) -> Column:
    """struct<first, last> of ``A-B`` or ``A.B.C.D-N``, in order; null if it is none or has more than ``most`` addresses."""
    t = F.replace(F.trim(target), F.lit(" "), F.lit(""))
    left, right = F.regexp_extract(t, r"^([^-]+)-(.+)$", 1), F.regexp_extract(t, r"^([^-]+)-(.+)$", 2)
    full = F.when(right.rlike(r"^\d{1,3}$"), F.concat(F.regexp_extract(left, r"^(.*\.)[^.]*$", 1), F.regexp_replace(right, r"^0+(?=\d)", ""))).otherwise(right)
    a, b = ipv4_number(left), ipv4_number(full)
    return F.when(F.abs(a - b) < most, F.struct(F.least(a, b).alias("first"), F.greatest(a, b).alias("last")))


def is_ipv6(c: Column) -> Column:
    h = "[0-9A-Fa-f]{1,4}"
    return c.rlike(rf"^(?:{h}:){{7}}{h}$|^(?=(?:[^:]*:){{2,7}}[^:]*$)(?!.*::.*::)(?:{h}(?::{h})*)?::(?:{h}(?::{h})*)?$")


def is_address(c: Column) -> Column:
    return c.rlike(rf"^{_IPV4}$") | is_ipv6(c)


def likely_domain(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z0-9._\-]*\.[A-Za-z0-9_\-]{2,}$")


def target_class(raw: Column) -> Column:
    """struct<kind, norm>: ip_range, cidr, ip, url, company, domain, subdomain or unknown."""
    t = F.trim(raw)
    cidr = t.rlike(rf"^{_IPV4}/(?:3[0-2]|[12]?\d)$") | (is_ipv6(F.regexp_extract(t, r"^([^/]*)/\d+$", 1)) & t.rlike(r"/(?:12[0-8]|1[01]\d|\d{1,2})$"))
    host = F.regexp_replace(F.regexp_extract(t, r"^(\[[^\]]*\]|[^:\s]*):[^:\s]*$", 1), r"[\[\]]", "")
    company = t.rlike("[\\x{4E00}-\\x{9FFF}]") | F.lower(t).rlike("|".join(w.replace(".", r"\.") for w in COMPANY_WORDS))
    name = F.lower(F.regexp_replace(t, r"\.$", ""))
    pair = lambda kind, norm: F.struct(F.lit(kind).alias("kind"), norm.alias("norm"))
    return (
        F.when(F.coalesce(t, F.lit("")) == "", pair("unknown", F.lit("")))
        .when(ip_range(t).isNotNull(), pair("ip_range", t))
        .when(cidr, pair("cidr", t))
        .when(is_address(t), pair("ip", t))
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\s]+"), pair("url", t))
        .when(is_address(host) | likely_domain(host), pair("url", F.concat(F.lit("http://"), t)))
        .when(company, pair("company", t))
        .when(likely_domain(t) & (root_domain(name) == name), pair("domain", name))
        .when(likely_domain(t), pair("subdomain", name))
        .otherwise(pair("unknown", t))
    )


def classified_targets(targets: DataFrame, column: str = "target") -> DataFrame:
    """Distinct (kind, norm) of ``targets``, without regard to case, ranges as their addresses."""
    one = targets.select(F.trim(column).alias("t")).where("t <> ''").groupBy(F.lower("t").alias("low")).agg(F.min("t").alias("t"))
    kinds = one.select("t", target_class(F.col("t")).alias("c")).select("t", "c.kind", "c.norm")
    spans = kinds.where("kind = 'ip_range'").select(ip_range(F.col("t")).alias("r"))
    ips = spans.select(F.explode(F.sequence("r.first", "r.last")).alias("n")).select(F.lit("ip").alias("kind"), ipv4_text(F.col("n")).alias("norm"))
    return kinds.where("kind <> 'ip_range'").select("kind", "norm").union(ips).distinct()


def target_kinds(c: Column) -> Column:
    """The kinds of target, of which several may hold: url, ip, domain, email, asn, icp, company."""
    url = c.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+")
    ip = is_address(c)
    email = c.rlike(r"^[^@]+@[^@]*\.[^@]*$")
    domain = c.contains(".") & ~c.rlike(r"[^\x00-\x7F]|\s") & ~url & ~ip & ~email
    asn = F.upper(F.trim(c)).rlike(r"^(?:AS)?\d+$")
    icp = F.upper(c).contains("ICP") | c.contains("备案") | (c.contains("京") & c.contains("号"))
    company = c.rlike("[\\x{4E00}-\\x{9FFF}]|" + "|".join(COMPANY_SUFFIXES))
    named = {"url": url, "ip": ip, "domain": domain, "email": email, "asn": asn, "icp": icp, "company": company}
    return F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in named.items()]))


def error_kind(err: Column) -> Column:
    """What a source's error message is about."""
    low = F.lower(err)
    any_of = lambda *w: low.rlike("|".join(w))
    return (
        F.when(err.isNull() | (err == ""), "ok")
        .when(any_of("panic"), "panic")
        .when(any_of("context deadline", "timeout"), "timeout")
        .when(any_of("no such host", "dial tcp"), "dns_or_dial")
        .when(any_of("401", "403", "unauthorized", "forbidden", "needs key", "needs fofa_key", "needs quake_key", "api key", "api error", "eof", "账号", "令牌"), "auth_required")
        .when(any_of("status 4", "status 5"), "http_status")
        .when(any_of("invalid json", "unmarshal"), "parse_error")
        .otherwise("other")
    )
