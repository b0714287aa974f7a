"""Extraction of labelled strings from text, redacted on the way out.

Java's ``\\b`` takes letters of all scripts for word characters; the rules mean ASCII words, so they look around instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.bind import bound

_B, _E = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"
_MAIL = r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}"
_ANY_MAIL = r"([a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,24})"
_PLATE = "京津沪渝冀豫云辽黑湘皖鲁新苏浙赣鄂桂甘晋蒙陕吉闽贵粤青藏川宁琼"


@dataclass(frozen=True)
class Rule:
    """``hint``: a cheap pattern without which the rule cannot match (never looked at if empty); ``quick``: one that matches as ``pattern`` does, for less."""

    label: str
    severity: str
    pattern: str
    hint: str = ""
    luhn: bool = False
    quick: str = ""


# Labels, severities and patterns; whole matches are reported, groups or not.
PII_RULES = (
    Rule("phone_cn", "high", rf"{_B}1[3-9]\d{{9}}{_E}", r"1[3-9]\d{9}"),
    Rule("idcard_cn_18", "high", rf"{_B}\d{{17}}[\dXx]{_E}", r"\d{17}"),
    Rule("idcard_cn_15", "high", rf"{_B}\d{{15}}{_E}", r"\d{15}"),
    Rule("bankcard_luhn", "high", rf"{_B}\d{{13,19}}{_E}", r"\d{13}", luhn=True),
    Rule("email", "mid", _MAIL, "@"),
    Rule("vehicle_plate_cn", "mid", rf"(?i)[{_PLATE}使领][A-Z][A-Z0-9]{{4,5}}[A-Z0-9挂学警港澳]", r"[\u4E00-\u9FFF]", quick=rf"(?i)(?=[\u4E00-\u9FFF])[{_PLATE}使领][A-Z][A-Z0-9]{{4,5}}[A-Z0-9挂学警港澳]"),
    Rule("passport_cn", "high", r"(?i)[GEP][A-Z0-9]{8}", quick=r"[GEPgep][A-Za-z0-9]{8}"),
    Rule("mac", "mid", r"(?i)(?:[0-9A-F]{2}[:-]){5}[0-9A-F]{2}", r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]"),
    Rule("ipv4_private", "mid", rf"{_B}(?:10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.168\.)\d{{1,3}}\.\d{{1,3}}{_E}", r"\d\.\d{1,3}\.\d"),
    Rule("qq", "mid", r"""(?i)(?:qq[\s号:：]{0,3}|qq[_-]?(?:no|number))["'`\s:=]+([1-9]\d{4,11})""", r"[Qq][Qq]"),
    Rule("wechat", "mid", r"""(?i)(?:wechat|微信|wx[_-]id)["'`\s:=号：]+([a-zA-Z][a-zA-Z0-9_\-]{5,19})""", r"[Ww](?:[Ee][Cc][Hh][Aa][Tt]|[Xx][_-][Ii][Dd])|微信"),
    Rule("social_credit_code_cn", "high", r"[0-9A-HJ-NPQRTUWXY]{2}\d{6}[0-9A-HJ-NPQRTUWXY]{10}"),
    Rule("us_ssn", "high", rf"{_B}\d{{3}}-\d{{2}}-\d{{4}}{_E}", r"\d-\d\d-\d"),
    Rule("iban", "high", rf"{_B}[A-Z]{{2}}\d{{2}}(?:[A-Z0-9]{{4}}\d{{7}}(?:[A-Z0-9]?){{0,16}}|[A-Z0-9]{{4}}\d{{14}}){_E}", r"[A-Z]{2}\d{2}[A-Z0-9]{4}"),
)
EMAIL_RULES = (
    Rule("general", "mid", rf"(?i){_ANY_MAIL[1:-1]}", "@"),
    *(
        Rule(label, "mid", rf"(?i)(?:{words})\s*[:：]?\s*{_ANY_MAIL}", "@")
        for label, words in {
            "support": "support|help|service|tech|技术支持|客服|服务", "hr": "hr|人力资源|人事|招聘|recruit", "sales": "sales|销售|商务|business",
            "admin": "admin|管理员|root|webmaster", "security": "security|安全|sec|cert|证书|ssl|tls", "finance": "finance|财务|accounting|财务部|会计",
            "legal": "legal|法务|法务部|合规|compliance", "pr": "pr|公关|媒体|press|media", "dev": "dev|开发|developer|研发|技术",
        }.items()
    ),
)
# Patterns of addresses, telephone numbers, licence numbers and mails.
IPV6 = (
    r"(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"
    r"|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}"
    r"|[0-9A-Fa-f]{1,4}::(?:[0-9A-Fa-f]{1,4}:){0,5}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){2}::(?:[0-9A-Fa-f]{1,4}:){0,4}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){3}::(?:[0-9A-Fa-f]{1,4}:){0,3}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){4}::(?:[0-9A-Fa-f]{1,4}:){0,2}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){5}::(?:[0-9A-Fa-f]{1,4}:){0,1}[0-9A-Fa-f]{1,4}"
    r"|(?:[0-9A-Fa-f]{1,4}:){6}::(?:[0-9A-Fa-f]{1,4}:){0,0}[0-9A-Fa-f]{1,4}"
    r")(?::\d{1,5})?"
)
PHONE = r"(?:\+?86[-\s]?)?1[3-9]\d{9}|0\d{2,3}[-\s]?\d{7,8}"
ICP = rf"[{_PLATE}][A-Z]?ICP备?\d{{5,}}(?:-\d+)?号?"
HTML_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"


def _ends(v: Column, head: int, middle: str, tail: int) -> Column:
    return F.concat(F.substring(v, 1, head), F.lit(middle), F.right(v, F.lit(tail)))


def redacted(value: Column, label: Column) -> Column:
    """A match with its middle hidden, by the rule's label. Lengths are code points."""
    n = F.length(value)
    user, domain = F.regexp_extract(value, "^([^@]*)", 1), F.regexp_extract(value, "(@.*)$", 1)
    return (
        F.when((label == "phone_cn") & (n == 11), _ends(value, 3, "****", 4))
        .when(label.startswith("idcard_cn") & (n >= 15), _ends(value, 6, "********", 4))
        .when(label.startswith("bankcard") & (n >= 8), _ends(value, 4, "****", 4))
        .when((label == "email") | (label == "general"), F.concat(F.when(F.length(user) > 3, F.concat(F.substring(user, 1, 2), F.lit("***"))).otherwise(user), domain))
        .when((label == "mac") & value.contains(":"), F.concat(F.regexp_extract(value, "^((?:[^:]*:){2}[^:]*)", 1), F.lit(":**:**")))
        .when(label == "ipv4_private", F.concat(F.regexp_extract(value, r"^(\d+\.\d+)", 1), F.lit(".**.**")))
        .when(label.isin("qq", "wechat") & (n > 4), F.concat(F.substring(value, 1, 2), F.lit("***")))
        .when((label == "social_credit_code_cn") & (n == 18), _ends(value, 6, "********", 4))
        .when(label == "us_ssn", F.concat(F.substring(value, 1, 3), F.lit("-**-****")))
        .when((label == "iban") & (n > 8), _ends(value, 4, "****", 4))
        .when(label == "passport_cn", F.concat(F.substring(value, 1, 4), F.lit("****")))
        # what has no rule of its own, or does not have its form, shows its first two characters
        .otherwise(F.concat(F.substring(value, 1, 2), F.lit("****")))
    )


def hits(text: Column, rules: Sequence[Rule], enable: Sequence[str] = (), disable: Sequence[str] = ()) -> Column:
    """array<struct<label, severity, value>> of every rule's matches."""
    parts = []
    for r in rules:
        if enable and r.label not in enable or r.label in disable:
            continue
        found = F.regexp_extract_all(text, F.lit(r.quick or r.pattern), F.lit(0))
        if r.luhn:
            found = F.filter(found, lambda v: F.call_function("luhn_check", v))
        if r.hint:
            there = text.rlike(r.hint) if len(r.hint) > 1 else text.contains(r.hint)
            found = F.when(there, found).otherwise(F.array().cast("array<string>"))
        parts.append(_labelled(found, r))
    return F.concat(*parts)


def _labelled(found: Column, r: Rule) -> Column:
    return F.transform(found, lambda v: F.struct(F.lit(r.label).alias("label"), F.lit(r.severity).alias("severity"), v.alias("value")))


def scan(df: DataFrame, text: str, rules: Sequence[Rule] = PII_RULES, keep: Sequence[str] = (), **lists: Sequence[str]) -> DataFrame:
    """A row for each match: ``keep``, label, severity, redacted. What was matched does not leave the scan."""
    found = df.select(*keep, F.explode(hits(F.col(text), rules, **lists)).alias("h"))
    return found.select(*keep, "h.label", "h.severity", redacted(F.col("h.value"), F.col("h.label")).alias("redacted"))


def ipv6_kind(ip: Column) -> Column:
    low = F.lower(F.regexp_replace(ip, "%.*$", ""))
    first = F.conv(F.regexp_extract(low, "^([0-9a-f]{1,4})", 1), 16, 10).cast("int")
    return (
        F.when(low.startswith("fe80"), "ipv6_linklocal").when(low.startswith("fd"), "ipv6_ula").when(low == "::1", "ipv6_loopback")
        .when(F.coalesce(first.bitwiseAND(0xE000) == 0x2000, F.lit(False)), "ipv6_public").otherwise("ipv6_other")
    )


def ipv6_redacted(ip: Column) -> Column:
    parts = F.split(ip, ":")
    n = F.size(parts)
    wide = F.concat(F.array_join(F.slice(parts, 1, 3), ":"), F.lit(":...:"), F.array_join(F.slice(parts, F.greatest(n - 1, F.lit(1)), F.lit(2)), ":"))
    return F.when(n >= 4, wide).when(F.length(ip) > 12, F.concat(F.substring(ip, 1, 12), F.lit("..."))).otherwise(ip)


def scan_ipv6(df: DataFrame, text: str, keep: Sequence[str] = ()) -> DataFrame:
    found = df.where(F.col(text).contains(":")).select(*keep, F.explode(F.regexp_extract_all(text, F.lit(IPV6), F.lit(0))).alias("ip"))
    return found.select(*keep, ipv6_kind(F.col("ip")).alias("label"), ipv6_redacted(F.col("ip")).alias("redacted"))


def distinct_matches(text: Column, pattern: str, most: int | None = None, group: int = 0) -> Column:
    """Matches without regard to case, the first spelling of each, at most ``most``, sorted."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda v: F.trim(v))
    ordered = F.array_sort(F.transform(found, lambda v, i: F.struct(F.lower(v).alias("low"), i.alias("at"), v.alias("value"))))

    def first(x: Column) -> Column:
        heads = F.filter(x, lambda r, i: (i == 0) | (r["low"] != F.get(x, i - 1)["low"]))
        kept = F.array_sort(F.transform(heads, lambda r: F.struct(r["at"].alias("at"), r["value"].alias("value"))))
        return F.array_sort(F.transform(F.slice(kept, 1, most) if most else kept, lambda r: r["value"]))

    return bound(ordered, first)


def contacts(html: Column, most: int = 200) -> Column:
    """struct<emails, phones, icp_numbers> of a page."""
    return F.struct(distinct_matches(html, HTML_MAIL, most).alias("emails"), distinct_matches(html, PHONE, most).alias("phones"), distinct_matches(html, ICP, most).alias("icp_numbers"))


# Fixed value: ids of site statistics.
TRACKER = rf"{_B}(UA-\d{{4,}}-\d{{1,3}}|G-[A-Z0-9]{{8,12}}|GTM-[A-Z0-9]{{6,8}}){_E}"
# Issuers and platforms whose certificates say nothing about the owner.
COMMON_ORGS = ("digicert inc", "let's encrypt", "globalsign nv-sa", "godaddy.com, inc.", "sectigo limited", "amazon", "google trust services", "cloudflare, inc.", "zerossl", "tencent technologies (shenzhen) company limited", "tencent cloud computing (beijing) co.", "alibaba (china) technology co., ltd.")


def trackers(body: Column) -> Column:
    baidu = F.transform(F.regexp_extract_all(body, F.lit(r"hm\.baidu\.com/hm\.js\?([a-f0-9]{20,})"), F.lit(1)), lambda v: F.concat(F.lit("hm.js?"), v))
    cnzz = F.transform(F.regexp_extract_all(body, F.lit(r"""s\d+\.cnzz\.com/[^"']+\?(?:id=)?(\d+)"""), F.lit(1)), lambda v: F.concat(F.lit("cnzz-"), v))
    return F.array_sort(F.array_distinct(F.concat(F.regexp_extract_all(body, F.lit(TRACKER), F.lit(1)), baidu, cnzz)))


def certificate_orgs(cert: Column) -> Column:
    """Organisations of a certificate's text, without those that everyone has."""
    subject = F.regexp_extract(cert, r"(?i)Subject:\s*\n((?:\s+[^\n]+\n?)+)", 1)
    names = F.concat(F.regexp_extract_all(subject, F.lit(r"(?im)^\s*Organization:\s*([^\n\r]+)"), F.lit(1)), F.regexp_extract_all(cert, F.lit(r"(?i)O=([^,/\n\r]+)"), F.lit(1)))
    names = F.transform(names, lambda v: F.btrim(F.trim(v), F.lit("\"'")))
    return F.array_sort(F.array_distinct(F.filter(names, lambda v: (v != "") & ~F.lower(v).isin(*COMMON_ORGS))))


# What API and socket endpoints look like in scripts.
_Q = "[\"']?"
API_PATTERNS = (rf"""{_Q}/api/[^"'\s]+{_Q}""", rf"""{_Q}/v\d+/[^"'\s]+{_Q}""", rf"""{_Q}(?:https?://[^/]+)/api/[^"'\s]+{_Q}""")
SOCKET_PATTERNS = (rf"""{_Q}wss?://[^"'\s]+{_Q}""", rf"""{_Q}/ws/[^"'\s]+{_Q}""", rf"""{_Q}/socket\.io/[^"'\s]+{_Q}""")


def script_endpoints(body: Column) -> Column:
    """array<struct<type, url>>: API and socket endpoints that a script names, quotes off; a pattern after another."""
    of = lambda kind, patterns: [F.transform(F.regexp_extract_all(body, F.lit(p), F.lit(0)), lambda v: F.struct(F.lit(kind).alias("type"), F.btrim(v, F.lit("\"'")).alias("url"))) for p in patterns]
    return F.concat(*of("api", API_PATTERNS), *of("websocket", SOCKET_PATTERNS))


def source_map_url(url: Column) -> Column:
    """Where a script's source map would be: beside it, without query."""
    return F.concat(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"\.js$", ""), F.lit(".js.map"))


def source_map_files(body: Column) -> Column:
    listed = F.regexp_extract(body, r'"sources":\s*\[([^\]]+)\]', 1)
    return F.filter(F.transform(F.split(listed, ","), lambda v: F.btrim(v, F.lit(' "`'))), lambda v: v != "")


def scraped(html: Column, link: str, title: str) -> Column:
    """array<struct<link, title>>: two patterns' first groups side by side."""
    zipped = F.arrays_zip(F.regexp_extract_all(html, F.lit(link), F.lit(1)).alias("link"), F.regexp_extract_all(html, F.lit(title), F.lit(1)).alias("title"))
    return zipped
