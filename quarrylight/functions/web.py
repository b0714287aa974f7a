"""Facts from recorded HTTP responses, DNS answers, WHOIS and RDAP records, robots and sitemap files.

Rule tables are constant arrays that array functions run through; HTML and scripts, which no built-in function parses, go
through Arrow functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.arrow import arrow_function
from quarrylight.functions.bind import bound, constants
from quarrylight.functions.text import _B, _E

# ---- HTTP fingerprints -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fingerprint:
    """One criterion: a header line's, body's or cookie's part, or a favicon hash."""

    product: str
    header: str = ""
    body: str = ""
    cookie: str = ""
    favicon: str = ""


# Fixed values: (product, place, what must be there).
PRODUCTS = (
    ("nginx", "header", "Server: nginx"),
    ("Apache", "header", "Server: Apache"),
    ("Microsoft-IIS", "header", "Server: Microsoft-IIS"),
    ("OpenResty", "header", "Server: openresty"),
    ("Caddy", "header", "Server: Caddy"),
    ("LiteSpeed", "header", "Server: LiteSpeed"),
    ("Tengine", "header", "Server: Tengine"),
    ("Tomcat", "header", "Server: Apache-Coyote"),
    ("Jetty", "header", "Server: Jetty"),
    ("Gunicorn", "header", "Server: gunicorn"),
    ("uvicorn", "header", "Server: uvicorn"),
    ("Node.js", "header", "X-Powered-By: Express"),
    ("PHP", "header", "X-Powered-By: PHP"),
    ("ASP.NET", "header", "X-Powered-By: ASP.NET"),
    ("Servlet", "header", "X-Powered-By: Servlet"),
    ("Cloudflare", "header", "Server: cloudflare"),
    ("Cloudflare", "header", "CF-RAY:"),
    ("Akamai", "header", "Server: AkamaiGHost"),
    ("Akamai", "header", "X-Akamai-Transformed:"),
    ("Fastly", "header", "X-Fastly-Request-ID:"),
    ("CloudFront", "header", "Via: CloudFront"),
    ("CloudFront", "header", "X-Amz-Cf-Id:"),
    ("Aliyun-WAF", "header", "Server: Tengine/Aserver"),
    ("Aliyun-CDN", "header", "Server: Tengine"),
    ("Tencent-CDN", "header", "X-Cache-Lookup: Hit From"),
    ("Tencent-CDN", "header", "Server: cdn"),
    ("Sucuri", "header", "X-Sucuri-ID:"),
    ("Imperva", "header", "X-Iinfo:"),
    ("ModSecurity", "header", "Server: Mod_Security"),
    ("WordPress", "body", "/wp-content/"),
    ("WordPress", "header", "X-Pingback:"),
    ("Drupal", "header", "X-Drupal-Cache:"),
    ("Drupal", "header", "X-Generator: Drupal"),
    ("Joomla", "body", 'content="Joomla'),
    ("Discuz!", "body", 'content="Discuz!'),
    ("phpBB", "body", 'content="phpBB'),
    ("MediaWiki", "body", 'content="MediaWiki'),
    ("Ghost", "body", 'content="Ghost '),
    ("Typecho", "body", 'content="Typecho'),
    ("DedeCMS", "body", 'content="DedeCMS'),
    ("MetInfo", "body", 'content="MetInfo'),
    ("ThinkCMF", "body", "thinkcmf"),
    ("Laravel", "cookie", "laravel_session="),
    ("Laravel", "cookie", "XSRF-TOKEN="),
    ("Django", "cookie", "csrftoken="),
    ("Django", "cookie", "sessionid="),
    ("Flask", "cookie", "session=ey"),
    ("Rails", "cookie", "_rails_session"),
    ("Spring", "header", "X-Application-Context:"),
    ("Spring-Boot", "body", '/error"><pre>'),
    ("Spring-Boot", "body", "Whitelabel Error Page"),
    ("Struts2", "body", "struts"),
    ("ThinkPHP", "body", "ThinkPHP"),
    ("FastAPI", "body", "<title>FastAPI"),
    ("Nuxt", "body", 'id="__nuxt'),
    ("Next.js", "body", 'id="__next'),
    ("Next.js", "header", "X-Powered-By: Next.js"),
    ("React", "body", "data-reactroot"),
    ("React", "body", "data-reactid"),
    ("Vue.js", "body", 'id="app" data-v-'),
    ("Vue.js", "body", 'data-server-rendered="true"'),
    ("Angular", "body", "ng-version="),
    ("Element-UI", "body", "el-button"),
    ("Ant-Design", "body", "ant-btn"),
    ("Swagger-UI", "body", "swagger-ui"),
    ("Swagger-UI", "body", "/swagger-resources"),
    ("GraphiQL", "body", "GraphiQL"),
    ("Actuator", "body", '"_links":{"self"'),
    ("Jenkins", "header", "X-Jenkins:"),
    ("Jira", "header", "X-AREQUESTID:"),
    ("Jira", "cookie", "JSESSIONID="),
    ("Confluence", "header", "X-Confluence-Request-Time:"),
    ("GitLab", "body", "GitLab.com"),
    ("Gitea", "header", "Set-Cookie: i_like_gitea"),
    ("Harbor", "header", "Set-Cookie: harbor_session"),
    ("Nacos", "body", "Nacos"),
    ("Apollo", "body", "apollo-portal"),
    ("Kibana", "body", "kbn-version"),
    ("Grafana", "body", "grafana"),
    ("Zabbix", "body", "Zabbix SIA"),
    ("Prometheus", "body", "Prometheus Time Series Collection"),
    ("WeblogicAdmin", "body", "Welcome to Weblogic Application"),
    ("phpMyAdmin", "body", "phpmyadmin.css.php"),
    ("Adminer", "body", "Adminer - Database management"),
    ("AliyunOSS", "body", "<HostId>oss-"),
    ("AWS-S3", "body", "<ListBucketResult"),
    ("MinIO", "header", "Server: MinIO"),
    ("Jenkins", "favicon", "81586312"),
    ("Spring-Boot", "favicon", "116323821"),
    ("GitLab", "favicon", "-1684273927"),
    ("Grafana", "favicon", "-1140212333"),
    ("Kibana", "favicon", "-1085141318"),
    ("Nacos", "favicon", "13750606"),
    ("Harbor", "favicon", "657337228"),
    ("Gitea", "favicon", "-1929969042"),
    ("Apache", "favicon", "-1664299192"),
)
# Spellings of products.
ALIASES = {
    "nextjs": "Next.js", "next.js": "Next.js", "swagger": "Swagger UI", "swagger-ui": "Swagger UI", "swagger ui": "Swagger UI", "wordpress": "WordPress", "nginx": "Nginx",
    "apache": "Apache", "apache httpd": "Apache", "openresty": "OpenResty", "tomcat": "Tomcat", "jetty": "Jetty", "gunicorn": "Gunicorn", "php": "PHP", "node.js": "Node.js",
    "nodejs": "Node.js", "vue": "Vue.js", "vue.js": "Vue.js", "react": "React", "angular": "Angular", "laravel": "Laravel", "django": "Django", "flask": "Flask",
    "spring": "Spring", "spring boot": "Spring Boot", "spring-boot": "Spring Boot", "cloudflare": "Cloudflare", "akamai": "Akamai", "fastly": "Fastly", "cloudfront": "CloudFront",
    "jenkins": "Jenkins", "gitlab": "GitLab", "gitea": "Gitea", "jquery": "jQuery",
}
FINGERPRINTS = tuple(Fingerprint(product, **{place: needle}) for product, place, needle in PRODUCTS)


def canonical_product(p: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair]), F.lower(p)), p)


def products(headers: Column, body: Column, favicon: Column, rules: Sequence[Fingerprint] = FINGERPRINTS) -> Column:
    """Sorted distinct products of a response; ``headers``: map of names to values. Case does not count."""
    rows = []
    for r in rules:
        name, _, value = r.header.lower().partition(":")
        rows.append({"product": ALIASES.get(r.product.lower(), r.product), "header": f"{name}:" if name else "", "value": value.strip(), "body": r.body.lower(), "cookie": r.cookie.lower(), "favicon": r.favicon})
    table = constants(rows, "product: string, header: string, value: string, body: string, cookie: string, favicon: string")
    lines = F.coalesce(F.transform(F.map_entries(headers), lambda e: F.lower(F.concat(e["key"], F.lit(": "), e["value"]))), F.array().cast("array<string>"))
    seen = F.struct(lines.alias("lines"), F.coalesce(F.lower(body), F.lit("")).alias("body"), F.coalesce(favicon, F.lit("")).alias("favicon"))

    def found(of: Column) -> Column:
        cookies = lambda c: F.exists(of["lines"], lambda x: (x.startswith("set-cookie:") | x.startswith("cookie:")) & F.contains(x, c))
        header = lambda r: F.exists(of["lines"], lambda x: F.startswith(x, r["header"]) & F.contains(x, r["value"]))

        def holds(r: Column) -> Column:
            return F.when(r["header"] != "", header(r)).when(r["body"] != "", F.contains(of["body"], r["body"])).when(r["cookie"] != "", cookies(r["cookie"])).otherwise(of["favicon"] == r["favicon"])

        return F.array_sort(F.array_distinct(F.transform(F.filter(table, holds), lambda r: r["product"])))

    return bound(seen, found)


def murmur3(data: bytes, seed: int = 0) -> int:
    """MurmurHash3 x86 32 bit, signed (Appleby's public algorithm)."""
    c1, c2, mask = 0xCC9E2D51, 0x1B873593, 0xFFFFFFFF
    rotate = lambda x, r: (x << r | x >> (32 - r)) & mask
    h, whole = seed, len(data) // 4 * 4
    for i in range(0, whole, 4):
        k = rotate(int.from_bytes(data[i : i + 4], "little") * c1 & mask, 15) * c2 & mask
        h = (rotate(h ^ k, 13) * 5 + 0xE6546B64) & mask
    if tail := data[whole:]:
        h ^= rotate(int.from_bytes(tail, "little") * c1 & mask, 15) * c2 & mask
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * factor & mask
    return h - (1 << 32) if h >> 31 else h


def wrapped_base64(data: bytes) -> bytes:
    """Base64 in lines of 76, each ended by a newline."""
    import base64

    return base64.encodebytes(data)


@arrow_function("int")
def favicon_hash(icon: pa.Array) -> pa.Array:
    """The hash by which favicons are searched for: murmur3 of the wrapped base64."""
    return pa.array([None if x is None else murmur3(wrapped_base64(x)) for x in icon.to_pylist()], pa.int32())


@arrow_function("int")
def murmur3_hash(data: pa.Array) -> pa.Array:
    return pa.array([None if x is None else murmur3(x) for x in data.to_pylist()], pa.int32())


# ---- vendors of networks and firewalls ---------------------------------------------------------------------------

# Fixed values: (vendor, kind, header name, part of its value or '').
VENDOR_HEADERS = (
    ("cloudflare", "cdn", "cf-ray", ""), ("cloudflare", "cdn", "server", "cloudflare"), ("cloudflare", "cdn", "cf-cache-status", ""),
    ("aws_cloudfront", "cdn", "x-amz-cf-id", ""), ("aws_cloudfront", "cdn", "x-amz-cf-pop", ""), ("aws_cloudfront", "cdn", "via", "cloudfront"), ("aws_elb", "cloud_lb", "server", "awselb"),
    ("akamai", "cdn", "x-akamai-transformed", ""), ("akamai", "cdn", "x-akamai-request-id", ""), ("akamai", "cdn", "akamai-ghost-ip", ""), ("akamai", "cdn", "x-akamai-edgescape", ""),
    ("fastly", "cdn", "x-fastly-request-id", ""), ("fastly", "cdn", "x-served-by", "cache-"), ("fastly", "cdn", "server", "fastly"), ("azure_frontdoor", "cdn", "x-azure-ref", ""),
    ("gcp_load_balancer", "cloud_lb", "server", "gws"), ("aliyun_cdn", "cdn", "via", "alicdn"), ("aliyun_cdn", "cdn", "eagleid", ""), ("aliyun_cdn", "cdn", "ali-swift-global-savetime", ""),
    ("aliyun_waf", "waf", "ali-swift-global-savetime", ""), ("aliyun_oss", "cloud_lb", "server", "aliyunoss"), ("tencent_cloud_cdn", "cdn", "server", "tcdn"), ("tencent_cloud_cdn", "cdn", "x-nws-log-uuid", ""),
    ("baidu_cdn", "cdn", "server", "jsp3"), ("qiniu_cdn", "cdn", "x-qiniu-request-id", ""), ("upyun", "cdn", "server", "marco"), ("incapsula_imperva", "waf", "x-iinfo", ""),
    ("incapsula_imperva", "waf", "x-cdn", "incapsula"), ("sucuri", "waf", "x-sucuri-id", ""), ("sucuri", "waf", "server", "sucuri/cloudproxy"), ("f5_big_ip", "waf", "x-waf-event-info", ""),
    ("f5_big_ip", "waf", "server", "bigip"), ("stackpath", "cdn", "x-cdn", "stackpath"), ("varnish", "cdn", "via", "varnish"), ("varnish", "cdn", "x-varnish", ""),
    ("safe3_waf", "waf", "x-powered-by-360wzb", ""), ("qiankun_waf", "waf", "qiankun-id", ""), ("anquanbao_waf", "waf", "x-powered-by-anquanbao", ""), ("yundun_360", "waf", "x-waf-status", ""),
    ("yundun_360", "waf", "server", "qianxin-waf"), ("knownsec_jiasule", "waf", "x-waf-rule", "jiasule"), ("knownsec_jiasule", "waf", "server", "jiasule-waf"),
)
# Fixed values: (vendor, kind, part of canonical names).
VENDOR_NAMES = (
    ("cloudflare", "cdn", "cloudflare.net"),
    ("cloudflare", "cdn", "cloudflare.com"),
    ("aws_cloudfront", "cdn", "cloudfront.net"),
    ("aws_elb", "cloud_lb", "elb.amazonaws.com"),
    ("aws_elb", "cloud_lb", "amazonaws.com"),
    ("akamai", "cdn", "akamaiedge.net"),
    ("akamai", "cdn", "akamaihd.net"),
    ("akamai", "cdn", "akamai.net"),
    ("akamai", "cdn", "akamaitechnologies.com"),
    ("akamai", "cdn", "edgekey.net"),
    ("akamai", "cdn", "edgesuite.net"),
    ("fastly", "cdn", "fastly.net"),
    ("fastly", "cdn", "fastlylb.net"),
    ("azure_frontdoor", "cdn", "azurefd.net"),
    ("azure_frontdoor", "cdn", "azureedge.net"),
    ("azure_app_service", "cloud_lb", "azurewebsites.net"),
    ("gcp_load_balancer", "cloud_lb", "ghs.googlehosted.com"),
    ("gcp_load_balancer", "cloud_lb", "lb.googleusercontent.com"),
    ("aliyun_cdn", "cdn", "alikunlun.com"),
    ("aliyun_cdn", "cdn", "kunlunca.com"),
    ("aliyun_cdn", "cdn", "kunlunar.com"),
    ("aliyun_cdn", "cdn", "kunlunwe.com"),
    ("aliyun_cdn", "cdn", "kunlunsl.com"),
    ("aliyun_cdn", "cdn", "alicdn.com"),
    ("aliyun_cdn", "cdn", "alikunlun.net"),
    ("aliyun_oss", "cloud_lb", "aliyuncs.com"),
    ("aliyun_oss", "cloud_lb", "oss-"),
    ("aliyun_slb", "cloud_lb", "aliyun-inc.com"),
    ("aliyun_slb", "cloud_lb", "slb-"),
    ("tencent_cloud_cdn", "cdn", "cdntip.com"),
    ("tencent_cloud_cdn", "cdn", "tcdn.qq.com"),
    ("tencent_cloud_cdn", "cdn", "qcloudcdn.cn"),
    ("tencent_cloud_cdn", "cdn", "dnspod.cn"),
    ("tencent_cloud_cdn", "cdn", "qcloudcdn.com"),
    ("tencent_cos", "cloud_lb", "myqcloud.com"),
    ("tencent_cos", "cloud_lb", "cos.tencentyun.com"),
    ("baidu_cdn", "cdn", "bdydns.com"),
    ("baidu_cdn", "cdn", "jomodns.com"),
    ("baidu_cdn", "cdn", "baidu.com"),
    ("baidu_cdn", "cdn", "baiducdn.com"),
    ("huawei_cloud_cdn", "cdn", "hwcdn.net"),
    ("huawei_cloud_cdn", "cdn", "cdnhwc1.com"),
    ("huawei_cloud_cdn", "cdn", "myhuaweicloud.com"),
    ("qiniu_cdn", "cdn", "qbox.me"),
    ("qiniu_cdn", "cdn", "qiniudns.com"),
    ("qiniu_cdn", "cdn", "qiniucdn.com"),
    ("wangsu", "cdn", "wsdvs.com"),
    ("wangsu", "cdn", "wscdns.com"),
    ("wangsu", "cdn", "wswebcdn.com"),
    ("wangsu", "cdn", "lxdns.com"),
    ("wangsu", "cdn", "ourwebpic.com"),
    ("wangsu", "cdn", "wsglb0.com"),
    ("upyun", "cdn", "upaiyun.com"),
    ("upyun", "cdn", "upyuncdn.com"),
    ("stackpath", "cdn", "stackpathdns.com"),
    ("stackpath", "cdn", "stackpathcdn.com"),
    ("cdn77", "cdn", "cdn77.org"),
    ("cdn77", "cdn", "cdn77.com"),
    ("bunnycdn", "cdn", "b-cdn.net"),
    ("bunnycdn", "cdn", "bunnycdn.com"),
    ("keycdn", "cdn", "kxcdn.com"),
    ("edgio_limelight", "cdn", "llnwd.net"),
    ("edgio_limelight", "cdn", "edgecast.net"),
    ("edgio_limelight", "cdn", "edgesuite.net"),
    ("section.io", "cdn", "section.io"),
    ("section.io", "cdn", "squixa.net"),
    ("knownsec_jiasule", "waf", "jiashule.com"),
    ("knownsec_jiasule", "waf", "jsl-cdn.com"),
)
# Fixed values: (service, part of a dangling canonical name that points to it); the first that matches counts.
HOSTED_NAMES = (
    ("GitHub Pages", "github.io"),
    ("GitHub Pages", "github.map.fastly.net"),
    ("AWS/S3", "s3.amazonaws.com"),
    ("AWS/S3", "s3-website"),
    ("Heroku", "herokudns.com"),
    ("Heroku", "herokuapp.com"),
    ("Heroku", "herokussl.com"),
    ("Bitbucket", "bitbucket.io"),
    ("Shopify", "myshopify.com"),
    ("Tumblr", "domains.tumblr.com"),
    ("Fastly", "fastly.net"),
    ("Ghost", "ghost.io"),
    ("Pantheon", "pantheonsite.io"),
    ("Tilda", "tilda.ws"),
    ("Unbounce", "unbouncepages.com"),
    ("HelpJuice", "helpjuice.com"),
    ("HelpScout", "helpscoutdocs.com"),
    ("Cargo", "cargocollective.com"),
    ("StatusPage", "statuspage.io"),
    ("Surge.sh", "surge.sh"),
    ("Intercom", "custom.intercom.help"),
    ("LaunchRock", "launchrock.com"),
    ("ReadTheDocs", "readthedocs.io"),
    ("Strikingly", "s.strikinglydns.com"),
    ("Uservoice", "uservoice.com"),
    ("Wordpress", "wordpress.com"),
    ("Acquia", "acquia-sites.com"),
    ("Netlify", "netlify.app"),
    ("Netlify", "netlify.com"),
    ("Vercel", "vercel-dns.com"),
    ("Vercel", "cname.vercel-dns.com"),
    ("Worksites.net", "alias.zerigo.com"),
    ("Azure (cloudapp)", "cloudapp.net"),
    ("Azure (cloudapp)", "cloudapp.azure.com"),
    ("Azure (cloudapp)", "trafficmanager.net"),
    ("Azure (cloudapp)", "azurewebsites.net"),
    ("Azure (cloudapp)", "blob.core.windows.net"),
    ("Google Cloud Storage", "storage.googleapis.com"),
    ("Squarespace", "squarespace.com"),
    ("Zendesk", "zendesk.com"),
)


def vendor_hits(headers: Column, names: Column) -> Column:
    """array<struct<vendor, kind, source>> of a response's headers (map) and canonical names (array), each once."""
    by_header = constants([{"vendor": v, "kind": k, "name": n, "part": p} for v, k, n, p in VENDOR_HEADERS], "vendor: string, kind: string, name: string, part: string")
    by_name = constants([{"vendor": v, "kind": k, "part": p} for v, k, p in VENDOR_NAMES], "vendor: string, kind: string, part: string")
    low = F.coalesce(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.lower(e["value"]).alias("v"))), F.array().cast("array<struct<k:string,v:string>>"))
    hit = lambda r, source: F.struct(r["vendor"].alias("vendor"), r["kind"].alias("kind"), F.lit(source).alias("source"))

    def found(of: Column) -> Column:
        headed = F.filter(by_header, lambda r: F.exists(of["h"], lambda e: (e["k"] == r["name"]) & F.contains(e["v"], r["part"])))
        named = F.filter(by_name, lambda r: F.contains(of["n"], r["part"]))
        return F.array_distinct(F.concat(F.transform(headed, lambda r: hit(r, "header")), F.transform(named, lambda r: hit(r, "cname"))))

    return bound(F.struct(low.alias("h"), F.coalesce(F.lower(F.array_join(names, " ")), F.lit("")).alias("n")), found)


def has_cdn(hits: Column) -> Column:
    return F.exists(hits, lambda h: h["kind"].isin("cdn", "waf"))


def hosted_service(cname: Column) -> Column:
    """The hosting service that a canonical name points to, for review; null if none."""
    table = constants([{"service": s, "part": p} for s, p in HOSTED_NAMES], "service: string, part: string")
    return bound(F.lower(cname), lambda low: F.get(F.filter(table, lambda r: F.contains(low, r["part"])), F.lit(0))["service"])


# ---- DNS ---------------------------------------------------------------------------------------------------------

_V = r"([A-Za-z0-9_\-]+)"
# Fixed values: (provider, type, part of the text, pattern of the value or '').
TXT_RULES = (
    ("github", "site_verification", "github-verification-", rf"(?i)github-verification[-=]{_V}"), ("github", "pages_verification", "_github-challenge-", rf"(?i)_github-challenge-{_V}"),
    ("gitlab", "verification", "gitlab-verification=", rf"(?i)gitlab-verification={_V}"), ("google_workspace", "site_verification", "google-site-verification=", rf"(?i)google-site-verification={_V}"),
    ("google_workspace", "spf_include", "_spf.google.com", ""), ("microsoft_365", "domain_verification", "ms=ms", rf"(?i){_B}ms=ms(\d+){_E}"), ("microsoft_365", "spf_include", "spf.protection.outlook.com", ""),
    ("apple", "domain_verification", "apple-domain-verification=", rf"(?i)apple-domain-verification={_V}"), ("aws_ses", "amazonses_dkim_or_verification", "amazonses:", r"(?i)amazonses:([A-Za-z0-9+/=]+)"),
    ("aws_ses", "spf_include", "amazonses.com", ""), ("aws_acm", "validation", "_acme-challenge", ""), ("atlassian", "site_verification", "atlassian-domain-verification=", rf"(?i)atlassian-domain-verification={_V}"),
    ("slack", "site_verification", "slack-domain-verification=", rf"(?i)slack-domain-verification={_V}"), ("zoom", "verification", "zoomverify=", rf"(?i)zoomverify={_V}"),
    ("notion", "verification", "notion-domain-verification=", rf"(?i)notion-domain-verification={_V}"), ("miro", "verification", "miro-verification=", ""), ("figma", "verification", "figma-domain-verification=", ""),
    ("hubspot", "site_verification", "hubspot-developer-verification=", ""), ("mailchimp", "spf_include", "servers.mcsv.net", ""), ("sendgrid", "spf_include", "sendgrid.net", ""),
    ("mailgun", "spf_include", "mailgun.org", ""), ("stripe", "verification", "stripe-verification=", ""), ("intercom", "verification", "intercom-verification-", ""),
    ("facebook", "domain_verification", "facebook-domain-verification=", rf"(?i)facebook-domain-verification={_V}"), ("linkedin", "verification", "linkedin-verification=", ""),
    ("dingtalk", "domain_verification", "dingtalk-site-verification=", rf"(?i)dingtalk-site-verification={_V}"), ("feishu", "domain_verification", "lark-domain-verification=", rf"(?i)lark-domain-verification={_V}"),
    ("feishu_alt", "domain_verification", "feishu-domain-verification=", ""), ("wechat_work", "domain_verification", "wxwork-site-verification=", ""), ("aliyun", "domain_verification", "aliyun-site-verification=", ""),
    ("aliyun_directmail", "spf_include", "spf1.dm.aliyun.com", ""), ("tencent_cloud", "domain_verification", "qcloud-site-verification=", ""), ("tencent_exmail", "spf_include", "spf.mail.qq.com", ""),
    ("163_qiyemail", "spf_include", "qiye.163.com", ""), ("baidu", "site_verification", "baidu-site-verification=", ""), ("cloudflare", "domain_verification", "cloudflare-verify.", ""),
    ("fastly", "tls_validation", "fastly", ""), ("akamai", "validation", "akamai", ""), ("letsencrypt", "validation", "_acme-challenge", ""),
)


def txt_tokens(txt: Column) -> Column:
    """array<struct<provider, type, value>> of a TXT record, in the order of the rules."""
    table = constants([{"provider": a, "type": b, "part": c, "pattern": d} for a, b, c, d in TXT_RULES], "provider: string, type: string, part: string, pattern: string")
    value = lambda r: F.when(r["pattern"] != "", F.call_function("regexp_extract", txt, r["pattern"], F.lit(1))).otherwise("")

    def found(low: Column) -> Column:
        return F.transform(F.filter(table, lambda r: F.contains(low, r["part"])), lambda r: F.struct(r["provider"].alias("provider"), r["type"].alias("type"), value(r).alias("value")))

    return bound(F.coalesce(F.lower(txt), F.lit("")), found)


def mail_posture(records: DataFrame, by: Sequence[str] = ("domain",)) -> DataFrame:
    """Per ``by``: mail servers, SPF record and its includes, DMARC record and policy, from (type, value) rows."""
    v = F.lower(F.trim("value"))
    spf = F.when((F.col("type") == "TXT") & v.startswith("v=spf1"), F.col("value"))
    dmarc = F.when((F.col("type") == "DMARC") & v.startswith("v=dmarc1"), F.col("value"))
    includes = F.transform(F.regexp_extract_all(spf, F.lit(r"(?i)include:([^\s]+)"), F.lit(1)), lambda x: F.lower(x))
    own = records.withColumns({"_mx": F.when(F.col("type") == "MX", v), "_spf": spf, "_inc": includes, "_dmarc": dmarc})
    return own.groupBy(*by).agg(
        F.array_sort(F.collect_set("_mx")).alias("mx"), F.max("_spf").alias("spf"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_inc")))).alias("spf_includes"),
        F.max("_dmarc").alias("dmarc"), F.lower(F.regexp_extract(F.max("_dmarc"), r"(?i)\bp\s*=\s*([a-z]+)", 1)).alias("dmarc_policy"),
    )


def wildcard_answer(ips: Column, wildcard_ips: Column, cname: Column, wildcard_cname: Column) -> Column:
    """An answer that a name's wildcard gives too: all its addresses are the wildcard's, and so is its canonical name, if both have one."""
    inside = (F.size(ips) > 0) & (F.size(wildcard_ips) > 0) & (F.size(F.array_except(ips, wildcard_ips)) == 0)
    return F.coalesce(inside, F.lit(False)) & F.coalesce(F.lower(cname) == F.lower(wildcard_cname), F.lit(True))


# ---- scripts and pages: strings ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ScriptRule:
    name: str
    kind: str
    severity: str
    pattern: str
    group: int
    least: int


_TAIL = r"(?:/[a-zA-Z0-9_.\-/?#=&%~+:]*)?"
# What is looked for in scripts and pages.
SCRIPT_RULES = tuple(
    ScriptRule(*r)
    for r in (
        ("absolute_url", "endpoint", "info", rf"https?://[a-zA-Z0-9_.\-]+(?::\d+)?{_TAIL}", 0, 12),
        ("api_path", "endpoint", "info", r"""["'](/(?:api|v\d|graphql|rest|internal|admin|auth|oauth|sso|user|users|account|portal|console|backend|service|services|gateway|public)(?:/[a-zA-Z0-9_.\-/?#=&%~+:]+)?)["']""", 1, 5),
        ("aws_access_key_id", "secret", "high", rf"{_B}(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{{16}}{_E}", 0, 20),
        ("aws_secret_key", "secret", "high", r"""(?i)aws(?:.{0,20})?(?:secret|secret_access_key)["'\s:=]+([A-Za-z0-9/+=]{40})""", 1, 40),
        ("aliyun_access_key", "secret", "high", rf"{_B}LTAI[A-Za-z0-9]{{16,20}}{_E}", 0, 20),
        ("tencent_secret_id", "secret", "high", rf"{_B}AKID[A-Za-z0-9]{{32,40}}{_E}", 0, 36),
        ("google_api_key", "secret", "high", rf"{_B}AIza[0-9A-Za-z_\-]{{35}}{_E}", 0, 39),
        ("google_oauth_id", "secret", "low", rf"{_B}[0-9]+-[0-9A-Za-z_]{{32}}\.apps\.googleusercontent\.com{_E}", 0, 60),
        ("azure_storage_key", "secret", "high", r"(?i)DefaultEndpointsProtocol=https;AccountName=[A-Za-z0-9]+;AccountKey=[A-Za-z0-9+/=]{40,}", 0, 60),
        ("github_token", "secret", "high", rf"{_B}(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{{36,251}}{_E}", 0, 40),
        ("gitlab_token", "secret", "high", rf"{_B}glpat-[A-Za-z0-9_\-]{{20,}}{_E}", 0, 26),
        ("slack_token", "secret", "high", rf"{_B}xox[baprs]-[A-Za-z0-9\-]{{10,}}{_E}", 0, 24),
        ("slack_webhook", "secret", "high", r"https://hooks\.slack\.com/services/T[A-Za-z0-9]{8,}/B[A-Za-z0-9]{8,}/[A-Za-z0-9]{20,}", 0, 60),
        ("bearer_token", "secret", "medium", r"""(?i)["']Bearer\s+([A-Za-z0-9_\-\.=]{20,})["']""", 1, 20),
        ("jwt", "secret", "medium", rf"{_B}eyJ[A-Za-z0-9_\-]{{6,}}\.eyJ[A-Za-z0-9_\-]{{6,}}\.[A-Za-z0-9_\-]{{6,}}{_E}", 0, 30),
        ("stripe_live_key", "secret", "critical", rf"{_B}sk_live_[A-Za-z0-9]{{24,}}{_E}", 0, 30),
        ("stripe_publishable", "secret", "low", rf"{_B}pk_live_[A-Za-z0-9]{{24,}}{_E}", 0, 30),
        ("twilio_sid", "secret", "medium", rf"{_B}AC[a-z0-9]{{32}}{_E}", 0, 34),
        ("sendgrid_key", "secret", "high", rf"{_B}SG\.[A-Za-z0-9_\-]{{22}}\.[A-Za-z0-9_\-]{{43}}{_E}", 0, 65),
        ("private_key_block", "secret", "critical", r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY( BLOCK)?-----", 0, 30),
        ("generic_api_key", "secret", "low", r"""(?i)(?:api[_-]?key|access[_-]?token|secret[_-]?key|auth[_-]?token)["'\s:=]+["']([A-Za-z0-9_\-]{24,})["']""", 1, 24),
        ("source_map", "secret", "medium", r"//[#@]\s*sourceMappingURL=([^\s]+\.map)", 1, 5),
    )
)


def script_findings(body: Column, rules: Sequence[ScriptRule] = SCRIPT_RULES) -> Column:
    """array<struct<type, rule, severity, value>>, distinct; of secrets only the first and last four characters stay."""
    return F.array_distinct(F.concat(*[_findings(body, r) for r in rules]))


def _findings(body: Column, r: ScriptRule) -> Column:
    found = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r.pattern), F.lit(r.group)), lambda v: F.trim(v)), lambda v: F.length(v) >= r.least)
    hidden = lambda v: F.when(F.length(v) >= 12, F.concat(F.substring(v, 1, 4), F.repeat(F.lit("*"), F.length(v) - 8), F.right(v, F.lit(4)))).otherwise(v)
    shown = lambda v: hidden(v) if r.kind == "secret" else v
    return F.transform(found, lambda v: F.struct(F.lit(r.kind).alias("type"), F.lit(r.name).alias("rule"), F.lit(r.severity).alias("severity"), shown(v).alias("value")))


def query_parameters(url: Column) -> Column:
    """Names of a URL's query parameters, in order, each once."""
    pairs = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    return F.array_distinct(F.filter(F.transform(pairs, lambda p: F.try_url_decode(F.regexp_extract(p, "^([^=]*)", 1))), lambda n: n != ""))


def resolved(base: Column, ref: Column) -> Column:
    """``ref`` as seen from ``base``, for absolute, host-relative and plain references."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^?#]*/)(?![^?#]*/)", 1)
    folder = F.when(F.length(folder) <= F.length(origin), F.concat(origin, F.lit("/"))).otherwise(folder)
    return F.when(ref.rlike(r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"), ref).when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref)).when(ref.startswith("/"), F.concat(origin, ref)).otherwise(F.concat(folder, ref))


def candidate_urls(target: Column, fallback: bool = True) -> Column:
    """A target with a scheme as it is; another one by https, then by http if ``fallback``."""
    t = F.trim(target)
    bare = [F.concat(F.lit(f"{s}://"), t) for s in (("https", "http") if fallback else ("https",))]
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).when(t.contains("://"), F.array(t)).otherwise(F.array(*bare))


def same_host(a: Column, b: Column) -> Column:
    """Without regard to case, ports and a leading ``www.``."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.lower(c), r":\d+$", ""), r"^www\.", "")
    return bare(a) == bare(b)


def robots(body: Column, base: Column) -> Column:
    """struct<allow, disallow, sitemap>: absolute URLs, each once."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, "[#\r].*$", "")))

    def of(key: str) -> Column:
        own = F.filter(lines, lambda x: F.lower(F.trim(F.regexp_extract(x, "^([^:]*):", 1))) == key)
        values = F.filter(F.transform(own, lambda x: F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1))), lambda v: v != "")
        return F.array_distinct(F.transform(values, lambda v: resolved(base, v)))

    return F.struct(of("allow").alias("allow"), of("disallow").alias("disallow"), of("sitemap").alias("sitemap"))


def sitemap(body: Column) -> Column:
    """struct<urls, nested>: locations of pages and of further sitemaps."""
    def locations(text: Column) -> Column:
        return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?is)<loc>\s*([^<]+?)\s*</loc>"), F.lit(1)), lambda v: F.trim(v)))

    inside = F.array_join(F.regexp_extract_all(body, F.lit(r"(?is)<sitemap>(.*?)</sitemap>"), F.lit(1)), " ")
    return F.struct(F.array_except(locations(body), locations(inside)).alias("urls"), locations(inside).alias("nested"))


def path_finding(path: Column, status: Column, content_type: Column, body: Column, need: Column) -> Column:
    """Does a recorded response confirm a finding? ``need``: 'env', 'json' or '' for what its body must be. Pages served in the place of files don't."""
    low, start = F.lower(body), F.lower(F.ltrim(body))
    html = F.lower(content_type).startswith("text/html") | start.startswith("<!doctype html") | start.startswith("<html")
    ext = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    fallback = F.coalesce(html, F.lit(False)) & (F.regexp_extract(path, r"(\.[^./]*)$", 1) != "") & ~ext.isin("html", "htm", "xhtml")
    env = ~low.contains("<html") & ~low.contains("<!doctype") & body.rlike(r"(?m)^\s*[^#\s=][^=\n]*=.+")
    json = F.ltrim(body).rlike(r"^\s*[{\[]")
    return F.coalesce(status.isin(200, 206) & ~fallback & F.when(need == "env", env).when(need == "json", json).otherwise(F.lit(True)), F.lit(False))


# Paths that should not be served: (path, category, severity, what its body must be or have).
PATH_RULES = (
    ("/.git/HEAD", "git", "high", "ref: refs/"), ("/.git/config", "git", "high", "[core]|[remote"), ("/.gitignore", "git", "info", ""), ("/.svn/entries", "svn", "high", ""), ("/.hg/store/00manifest.i", "hg", "high", ""),
    ("/.bzr/branch-format", "bzr", "high", ""), ("/.env", "env", "critical", "env"), ("/.env.local", "env", "critical", "env"), ("/.env.production", "env", "critical", "env"), ("/config.json", "config", "medium", "json"),
    ("/config.yaml", "config", "medium", ""), ("/config.yml", "config", "medium", ""), ("/web.config", "config", "high", ""), ("/appsettings.json", "config", "high", "json"), ("/.DS_Store", "macos", "medium", ""),
    ("/Thumbs.db", "windows", "low", ""), ("/backup.zip", "backup", "high", ""), ("/backup.tar.gz", "backup", "high", ""), ("/backup.sql", "backup", "critical", ""), ("/db.sql", "backup", "critical", ""),
    ("/database.sql", "backup", "critical", ""), ("/dump.sql", "backup", "critical", ""), ("/wp-config.php.bak", "backup", "critical", ""), ("/wp-config.php~", "backup", "critical", ""), ("/.ssh/id_rsa", "ssh", "critical", "PRIVATE KEY"),
    ("/.aws/credentials", "aws", "critical", "aws_access_key_id|[default]"), ("/.aws/config", "aws", "high", ""), ("/robots.txt", "discovery", "info", "user-agent|disallow"), ("/sitemap.xml", "discovery", "info", "<urlset|<sitemapindex"),
    ("/sitemap_index.xml", "discovery", "info", ""), ("/security.txt", "discovery", "info", ""), ("/.well-known/security.txt", "discovery", "info", ""), ("/crossdomain.xml", "discovery", "low", ""),
    ("/clientaccesspolicy.xml", "discovery", "low", ""), ("/swagger.json", "api", "medium", "json"), ("/swagger/v1/swagger.json", "api", "medium", "json"), ("/swagger-ui.html", "api", "medium", ""), ("/v2/api-docs", "api", "medium", ""),
    ("/v3/api-docs", "api", "medium", ""), ("/openapi.json", "api", "medium", "json"), ("/graphql", "api", "low", ""), ("/server-status", "monitoring", "low", ""), ("/server-info", "monitoring", "low", ""), ("/nginx_status", "monitoring", "low", ""),
    ("/phpinfo.php", "monitoring", "medium", ""), ("/info.php", "monitoring", "medium", ""), ("/test.php", "monitoring", "low", ""), ("/actuator", "actuator", "low", ""), ("/actuator/health", "actuator", "info", ""),
    ("/actuator/env", "actuator", "high", ""), ("/actuator/heapdump", "actuator", "critical", ""), ("/actuator/mappings", "actuator", "low", ""), ("/actuator/loggers", "actuator", "low", ""), ("/env", "actuator", "high", ""),
    ("/dump", "actuator", "high", ""), ("/trace", "actuator", "low", ""), ("/phpmyadmin/", "admin", "low", ""), ("/admin/", "admin", "info", ""), ("/console/", "admin", "low", ""), ("/druid/index.html", "admin", "medium", ""),
    ("/jolokia/list", "admin", "medium", ""), ("/_cat", "admin", "medium", ""), ("/package.json", "project", "info", "json"), ("/composer.json", "project", "info", ""), ("/composer.lock", "project", "info", ""),
    ("/Gemfile.lock", "project", "info", ""), ("/yarn.lock", "project", "info", ""),
)


def path_findings(responses: DataFrame, rules: Sequence[tuple[str, str, str, str]] = PATH_RULES) -> DataFrame:
    """Recorded ``responses`` (url, path, status, content_type, body) whose path a rule names and whose body confirms it: url, path, category, severity."""
    spark = responses.sparkSession
    table = spark.range(1).select(F.inline(constants([dict(zip(("path", "category", "severity", "need"), r, strict=True)) for r in rules], "path: string, category: string, severity: string, need: string")))
    met = responses.join(F.broadcast(table), "path")
    own = F.col("need").isin("", "env", "json")
    has = own | F.exists(F.split("need", r"\|"), lambda x: F.contains(F.lower("body"), F.lower(x)))
    good = path_finding(F.col("path"), F.col("status"), F.col("content_type"), F.col("body"), F.when(own, F.col("need")).otherwise(""))
    return met.where(good & has).select("url", "path", "category", "severity")


def severity_rank(s: Column) -> Column:
    return F.when(s == "critical", 5).when(s == "high", 4).when(s == "medium", 3).when(s == "low", 2).otherwise(1)


# ---- ports -------------------------------------------------------------------------------------------------------

# Usual services of ports; a fuller map may be given.
SERVICES = {
    7: "echo", 9: "discard", 13: "daytime", 17: "qotd", 19: "chargen", 20: "ftp-data", 21: "ftp", 22: "ssh", 23: "telnet", 25: "smtp", 37: "time", 43: "whois",
    53: "dns", 67: "dhcp", 69: "tftp", 79: "finger", 80: "http", 88: "kerberos", 109: "pop2", 110: "pop3", 111: "rpcbind", 113: "ident", 119: "nntp",
    123: "ntp", 135: "msrpc", 137: "netbios-ns", 138: "netbios-dgm", 139: "netbios-ssn", 143: "imap", 161: "snmp", 162: "snmptrap", 179: "bgp", 199: "smux",
    389: "ldap", 427: "svrloc", 443: "https", 444: "snpp", 445: "smb", 464: "kpasswd", 465: "smtps", 500: "isakmp", 513: "rlogin", 514: "syslog", 515: "lpd",
    543: "klogin", 544: "kshell", 548: "afp", 554: "rtsp", 563: "nntps", 587: "submission", 593: "msrpc", 631: "ipp", 636: "ldaps", 646: "ldp", 873: "rsync",
    902: "vmware-auth", 989: "ftps-data", 990: "ftps", 993: "imaps", 995: "pop3s", 1025: "msrpc", 1080: "socks", 1099: "java-rmi", 1158: "oracle-em",
    1194: "openvpn", 1433: "mssql", 1434: "mssql-mon", 1521: "oracle", 1604: "icabrowser", 1701: "l2tp", 1723: "pptp", 1755: "wms", 1900: "upnp",
    2000: "cisco-sccp", 2049: "nfs", 2082: "cpanel", 2083: "cpanel-ssl", 2086: "whm", 2087: "whm-ssl", 2095: "webmail", 2096: "webmail-ssl", 2121: "ftp-alt",
    2181: "zookeeper", 2222: "ssh-alt", 2375: "docker", 2376: "docker-tls", 2483: "oracle-tns", 2484: "oracle-tns-ssl", 2638: "sybase", 3000: "grafana",
    3001: "node-alt", 3128: "squid", 3268: "ldap-gc", 3269: "ldaps-gc", 3306: "mysql", 3389: "rdp", 3690: "svn", 4000: "icq", 4369: "epmd", 4444: "krb524",
    4500: "ipsec-nat-t", 4848: "glassfish", 5000: "upnp", 5001: "commplex-link", 5060: "sip", 5061: "sips", 5222: "xmpp-client", 5269: "xmpp-server",
    5353: "mdns", 5432: "postgres", 5555: "freeciv", 5601: "kibana", 5672: "amqp", 5683: "coap", 5800: "vnc-http", 5900: "vnc", 5938: "teamviewer",
    5984: "couchdb", 5985: "winrm", 5986: "winrm-https", 6000: "x11", 6379: "redis", 6443: "kubernetes-api", 6667: "irc", 6697: "ircs", 7000: "afs3",
    7001: "weblogic", 7002: "weblogic-ssl", 7077: "spark", 7474: "neo4j", 7547: "tr-069", 7777: "cba8", 8000: "http-alt", 8001: "http-alt", 8008: "http-alt",
    8009: "ajp", 8010: "xmpp-conference", 8020: "hadoop-namenode", 8042: "hadoop-rm", 8069: "odoo", 8080: "http-proxy", 8081: "http-alt", 8086: "influxdb",
    8087: "graylog", 8088: "hadoop-rm-ui", 8089: "splunk", 8090: "atlassian-confluence", 8091: "couchbase-mgmt", 8161: "activemq", 8200: "vault",
    8333: "bitcoin", 8388: "shadowsocks", 8443: "https-alt", 8500: "consul", 8530: "wsus", 8531: "wsus-ssl", 8649: "ganglia", 8686: "jmx", 8761: "eureka",
    8834: "nessus", 8888: "http-alt", 9000: "sonar", 9001: "tor", 9042: "cassandra", 9060: "websphere", 9090: "prometheus", 9091: "transmission-rpc",
    9092: "kafka", 9100: "printer", 9200: "elasticsearch", 9300: "elastic-tcp", 9418: "git", 9999: "abyss", 10000: "webmin", 10250: "kubelet",
    11211: "memcached", 12345: "netbus", 15672: "rabbitmq-mgmt", 16992: "amt", 16993: "amt-ssl", 20000: "dnp", 25565: "minecraft", 27017: "mongodb",
    27018: "mongodb-shard", 27019: "mongodb-config", 28017: "mongodb-http", 32400: "plex", 37777: "dahua-dvr", 47808: "bacnet", 49152: "msrpc",
    50000: "ibm-db2", 50030: "hadoop-jobtracker", 50060: "hadoop-tasktracker", 50070: "hadoop-namenode-ui", 50075: "hadoop-datanode",
}


def port_service(port: Column, services: dict[int, str] | None = None) -> Column:
    """The usual service of a port; of 6660 to 6667 all are chat ports."""
    if services is None:
        return F.when(port.between(6660, 6667), "irc").otherwise(port_service(port, SERVICES))
    return F.element_at(F.create_map(*[F.lit(x) for pair in (services or SERVICES).items() for x in pair]), port)


def port_list(spec: Column) -> Column:
    """Sorted distinct ports of ``80, 443; 8000-8010``; null if a part is no port or range within 1 to 65535."""
    parts = F.filter(F.split(spec, r"[,; ]+"), lambda p: p != "")
    low = lambda p: F.regexp_extract(p, r"^(\d{1,6})", 1).cast("int")
    high = lambda p: F.regexp_extract(p, r"(\d{1,6})$", 1).cast("int")
    good = F.forall(parts, lambda p: p.rlike(r"^\d{1,6}(-\d{1,6})?$"))
    fair = F.forall(parts, lambda p: (low(p) >= 1) & (high(p) <= 65535) & (low(p) <= high(p)))
    return F.when(good, F.when(fair, F.array_sort(F.array_distinct(F.flatten(F.transform(parts, lambda p: F.sequence(low(p), high(p))))))))


def host_port(s: Column) -> Column:
    """struct<host, port>: scheme, path and brackets off; port 0 if there is none."""
    t = F.regexp_replace(F.regexp_replace(F.trim(s), r"^.*?://", ""), r"[/?#].*$", "")
    pattern = r"^(\[[^\]]*\]|[^:]*):(\d{1,5})$"
    host = F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 1)).otherwise(t)
    return F.struct(F.regexp_replace(host, r"[\[\]]", "").alias("host"), F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 2).cast("int")).otherwise(0).alias("port"))


def printable(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"[^\x20-\x7E]+", " "))


# ---- WHOIS and RDAP ----------------------------------------------------------------------------------------------

# Fixed values: (field, keys, which value counts).
WHOIS_FIELDS = (
    ("registrar", ("registrar", "sponsoring registrar"), "first"), ("registrar_url", ("registrar url",), "first"), ("created", ("creation date", "created", "registered", "registered on"), "first"),
    ("updated", ("updated date", "last updated", "last modified"), "first"), ("expires", ("registry expiry date", "registrar registration expiration date", "expiry date", "expiration date", "expires"), "first"),
    ("nameservers", ("name server", "nserver"), "lower_list"), ("status", ("domain status",), "list"), ("registrant_email", ("registrant email", "registrant contact email"), "lower_last"),
    ("registrant_name", ("registrant name",), "last"), ("registrant_org", ("registrant organization", "registrant org", "registrant"), "first"), ("registrant_country", ("registrant country",), "last"),
    ("admin_email", ("admin email",), "lower_last"), ("tech_email", ("tech email",), "lower_last"),
)
PERSONAL = ("registrant_email", "registrant_name", "admin_email", "tech_email")


def whois(body: Column, personal: bool = False) -> Column:
    """struct of WHOIS_FIELDS; personal ones are hashed unless ``personal``."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, "\r", "")))
    pairs = F.filter(F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.regexp_extract(x, "^([^:]+):", 1))).alias("k"), F.trim(F.regexp_extract(x, "^[^:]+:(.*)$", 1)).alias("v"))), lambda p: (p["k"] != "") & (p["v"] != ""))
    out = []
    for name, keys, rule in WHOIS_FIELDS:
        values = F.transform(_whois_values(pairs, keys), lambda p: p["v"])
        values = F.transform(values, lambda v: F.lower(v)) if rule.startswith("lower") else values
        value = F.array_distinct(values) if rule.endswith("list") else F.get(values, F.lit(0)) if rule == "first" else F.try_element_at(values, F.lit(-1))
        if name in PERSONAL and not personal:
            value = F.substring(F.sha2(value, 256), 1, 16)
        out.append(value.alias(name))
    return F.struct(*out)


def _whois_values(pairs: Column, keys: Sequence[str]) -> Column:
    return F.filter(pairs, lambda p: p["k"].isin(*keys))


def whois_referral(body: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(body, r"(?i)(?:Registrar WHOIS Server|whois server|refer)\s*:\s*([A-Za-z0-9.\-]+)", 1)), F.lit(""))


@arrow_function("array<struct<role: string, name: string, organization: string, email: string, phone: string, country: string>>")
def rdap_contacts(record: pa.Array) -> pa.Array:
    """Contacts of an RDAP answer (JSON text) and of the entities within entities; those without a name, organisation, mail or phone go."""
    import json

    def of(entity: dict) -> dict:
        out = {"role": ",".join(entity.get("roles") or []), "name": "", "organization": "", "email": "", "phone": "", "country": ""}
        card = entity.get("vcardArray") or []
        for p in card[1] if len(card) > 1 and isinstance(card[1], list) else []:
            if not isinstance(p, list) or len(p) < 4:
                continue
            key, v = str(p[0]).lower(), p[3]
            plain = v if isinstance(v, str) else ""
            if key == "fn":
                out["name"] = plain
            elif key == "org":
                out["organization"] = str(v[0]) if isinstance(v, list) and v else plain
            elif key == "email":
                out["email"] = plain.lower()
            elif key == "tel":
                out["phone"] = plain
            elif key == "adr" and isinstance(v, list) and len(v) > 6 and isinstance(v[6], str):
                out["country"] = v[6]
        return out

    def walk(entities) -> list[dict]:
        return [c for e in entities or [] if isinstance(e, dict) for c in (of(e), *walk(e.get("entities")))]

    rows = []
    for x in record.to_pylist():
        try:
            found = walk(json.loads(x or "{}").get("entities"))
        except (ValueError, AttributeError):
            found = []
        rows.append([c for c in found if c["name"] or c["organization"] or c["email"] or c["phone"]])
    text = pa.string()
    return pa.array(rows, pa.list_(pa.struct([(n, text) for n in ("role", "name", "organization", "email", "phone", "country")])))


def contact_pivots(contacts: Column) -> Column:
    """Values by which other records of the same owner may be found: mails, organisations, registrants' names; lower case, each once."""
    values = F.flatten(F.transform(contacts, lambda c: F.array(c["email"], c["organization"], F.when(c["role"] == "registrant", c["name"]))))
    return F.array_distinct(F.filter(F.transform(values, lambda v: F.lower(F.trim(v))), lambda v: F.coalesce(v != "", F.lit(False))))


# ---- HTML and scripts by parser ----------------------------------------------------------------------------------


class _Page(HTMLParser):
    """Collects tags with attributes, the title, forms with their fields."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.tags: list[tuple[str, dict[str, str]]] = []
        self.forms: list[dict] = []
        self.title: list[str] = []
        self._in_title = self._titled = False
        self._form: dict | None = None
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        self.tags.append((tag, a))
        if tag == "title":
            self._in_title = not self._titled
        elif tag == "form":
            self._form = {"action": a.get("action", ""), "method": (a.get("method") or "GET").upper(), "inputs": []}
            self.forms.append(self._form)
        elif tag in ("input", "textarea", "select") and self._form is not None and a.get("name"):
            self._form["inputs"].append(a["name"])

    def handle_endtag(self, tag: str) -> None:
        if tag == "title" and self._in_title:
            self._in_title, self._titled = False, True
        elif tag == "form":
            self._form = None

    def handle_data(self, data: str) -> None:
        if self._in_title:
            self.title.append(data)


# What is no reference, and what names a script.
_SKIPPED = ("data:", "javascript:", "mailto:", "tel:")
_SCRIPT_NAME = re.compile(r"""["']([^"'\s<>]+?\.js(?:\?[^"'\s<>]*)?)["']""")


def _joined(base: str, ref: str) -> str:
    try:
        return urljoin(base, ref.strip())
    except ValueError:
        return ""


def references_of(base: str, body: str, content_type: str) -> list[str]:
    """What a page or script refers to: absolute URLs without fragments, each once, in order."""
    raw: list[str] = []
    if "html" in content_type.lower():
        tags = _Page(body).tags
        for tag, attr in (("script", "src"), ("link", "href"), ("a", "href"), ("iframe", "src"), ("form", "action")):
            raw += [a[attr] for t, a in tags if t == tag and attr in a and (tag != "link" or a.get("rel") in ("modulepreload", "preload", "stylesheet"))]
    raw += _SCRIPT_NAME.findall(body)
    found = (urldefrag(_joined(base, r))[0] for r in raw if r.strip() and not r.strip().startswith(_SKIPPED))
    return list(dict.fromkeys(u for u in found if u))


def meta_of(url: str, html: str) -> dict:
    """Title, meta and Open Graph values, canonical address, icons (20), links to other hosts (100)."""
    page = _Page(html)
    flat = lambda s: " ".join(s.split())
    meta, graph, icons, outside, canonical = {}, {}, [], [], ""
    host = urlsplit(url).netloc.lower()
    for tag, a in page.tags:
        if tag == "meta":
            key = next((a[k].strip().lower() for k in ("name", "http-equiv", "property") if k in a), "")
            if key and flat(a.get("content", "")):
                (graph if key.startswith("og:") else meta)[key] = flat(a["content"])
        elif tag == "link" and "rel" in a and "href" in a:
            rel = a["rel"].lower()
            canonical = canonical or (_joined(url, a["href"]) if "canonical" in rel else "")
            if "icon" in rel:
                icons.append(_joined(url, a["href"]))
        elif tag == "a" and "href" in a:
            to = _joined(url, a["href"])
            parts = urlsplit(to)
            if parts.scheme and parts.netloc and parts.netloc.lower() != host:
                outside.append(to)
    return {"title": flat("".join(page.title)), "meta": list(meta.items()), "open_graph": list(graph.items()), "canonical": canonical, "icons": list(dict.fromkeys(icons))[:20], "external_links": list(dict.fromkeys(outside))[:100]}


def markup_escapes_only(html: Column) -> Column:
    """``html`` with titles of which a parser undoes ``&lt;``, ``&gt;`` and ``&amp;`` alone: any other ampersand of theirs is text.

    For titles that were cut off within an escape, or as they were written.
    """
    return F.regexp_replace(html, r"&(?!(?:lt|gt|amp);)(?=[^<]*</title>)", "&amp;")


@arrow_function("array<string>")
def references(base: pa.Array, body: pa.Array, content_type: pa.Array) -> pa.Array:
    return pa.array([references_of(u or "", b or "", c or "") for u, b, c in zip(base.to_pylist(), body.to_pylist(), content_type.to_pylist(), strict=True)], pa.list_(pa.string()))


@arrow_function("array<struct<action: string, method: string, inputs: array<string>>>")
def forms(url: pa.Array, body: pa.Array) -> pa.Array:
    """A page's forms: absolute action, method (GET unless named), names of fields."""
    rows = [[{**f, "action": _joined(u or "", f["action"])} for f in _Page(b or "").forms] for u, b in zip(url.to_pylist(), body.to_pylist(), strict=True)]
    return pa.array(rows, pa.list_(pa.struct([("action", pa.string()), ("method", pa.string()), ("inputs", pa.list_(pa.string()))])))


@arrow_function("struct<title: string, meta: map<string, string>, open_graph: map<string, string>, canonical: string, icons: array<string>, external_links: array<string>>")
def page_meta(url: pa.Array, html: pa.Array) -> pa.Array:
    s, names = pa.string(), pa.list_(pa.string())
    kind = pa.struct([("title", s), ("meta", pa.map_(s, s)), ("open_graph", pa.map_(s, s)), ("canonical", s), ("icons", names), ("external_links", names)])
    return pa.array([meta_of(u or "", h or "") for u, h in zip(url.to_pylist(), html.to_pylist(), strict=True)], kind)


_JS = re.compile(r"""//[^\n]*|/\*.*?\*/|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<template>`(?:[^`\\]|\\.)*`)|(?P<plus>\+)|\s+|(?P<other>[\w$.]+|.)""", re.S)
_SHAPE = re.compile(r"(?:/|\{var\})[A-Za-z0-9_\-./?#=&%~+:{},*]*|https?://[A-Za-z0-9._\-:]\S*|wss?://[A-Za-z0-9._\-:]\S*")


def _template(body: str) -> str:
    """A template with ``{var}`` in the place of each expression, whatever braces that has."""
    out, i = [], 0
    while i < len(body):
        if body.startswith("${", i):
            depth, i = 1, i + 2
            while i < len(body) and depth:
                depth += {"{": 1, "}": -1}.get(body[i], 0)
                i += 1
            out.append("{var}")
        else:
            out.append(body[i])
            i += 1
    return "".join(out)


def script_paths_of(source: str) -> list[str]:
    """Addresses in a script: strings, joined constants, templates. A scan of tokens, not a parser: broken scripts give what can be read."""
    found: list[str] = []
    parts: list[str] = []
    joinable = False
    for m in _JS.finditer(source):
        kind = m.lastgroup
        if kind in ("string", "template"):
            value = m[0][1:-1] if kind == "string" else _template(m[0][1:-1])
            value = re.sub(r"\\(.)", r"\1", value)
            if joinable and parts and kind == "string":
                parts[-1] += value
            else:
                parts.append(value)
            joinable = False
        elif kind == "plus":
            joinable = bool(parts)
        elif kind == "other":
            joinable = False
            found += parts
            parts = []
    found += parts
    return [v for v in dict.fromkeys(found) if 4 <= len(v) <= 1024 and _SHAPE.fullmatch(v)]


@arrow_function("array<string>")
def script_paths(source: pa.Array) -> pa.Array:
    return pa.array([script_paths_of(x or "") for x in source.to_pylist()], pa.list_(pa.string()))


# ---- archives ----------------------------------------------------------------------------------------------------


def archive_time(ts: Column) -> Column:
    """A 14-digit time as a timestamp."""
    return F.try_to_timestamp(ts, F.lit("yyyyMMddHHmmss"))


def distinct_names(values: Column) -> Column:
    """Trimmed values without regard to case, the first spelling of each, in order."""
    own = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: F.coalesce(v != "", F.lit(False)))
    ordered = F.array_sort(F.transform(own, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("at"), v.alias("value"))))

    def first(x: Column) -> Column:
        heads = F.filter(x, lambda r, i: (i == 0) | (r["low"] != F.get(x, i - 1)["low"]))
        return F.transform(F.array_sort(F.transform(heads, lambda r: F.struct(r["at"].alias("at"), r["value"].alias("value")))), lambda r: r["value"])

    return bound(ordered, first)
