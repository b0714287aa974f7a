"""Rule tables of any size over recorded responses: needles are looked for together.

A rule has criteria; a criterion is a needle in a place (header, body, title, cookie) or a favicon hash. Rules with mode
'or' hold if one of their criteria does, those with mode 'and' if all do. Needles go to the tasks as one automaton
while they are few enough, else by hash as several of bounded size, each with a pass of its own; favicon hashes meet by
equality.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from quarrylight.functions import literals

PLACES = ("header", "body", "title", "cookie")
#: Words so common that they say nothing about a product.
COMMON = frozenset("login index home admin html http https title body head script style content error welcome portal system user password".split())
#: Needles of one automaton, about.
MOST_NEEDLES = 200_000


def specific(needle: str, least: int = 4) -> bool:
    """Is a needle long and rare enough to be evidence?"""
    low = needle.strip().lower()
    return len(low) >= least and low not in COMMON


def matched(responses: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """Distinct (key, product). ``responses``: key, header, body, title, cookie, favicon (text). ``rules``: rule, product, mode, place, needle."""
    own = rules.select("rule", "product", "mode", "place", F.lower("needle").alias("needle")).distinct()
    # needles that say nothing are neither sought nor needed
    own = own.where(~F.col("place").isin(*PLACES) | (F.length(F.trim("needle")) >= 2) & ~F.trim("needle").isin(*COMMON))
    needed = own.groupBy("rule").agg(F.count("*").alias("_needed"))
    sought = own.where(F.col("place").isin(*PLACES)).select("place", "needle").distinct()
    parts = max(1, -(-sought.count() // MOST_NEEDLES))
    hits = responses.select(key, F.lit("favicon").alias("place"), F.lower("favicon").alias("needle")).where("needle IS NOT NULL")
    for i in range(parts):
        rows = sought.where(F.pmod(F.xxhash64("place", "needle"), F.lit(parts)) == i).collect()
        found = _hits(responses, {p: sorted({r["needle"] for r in rows if r["place"] == p and specific(r["needle"], 2)}) for p in PLACES}, key)
        hits = hits.union(found)
    met = hits.join(own, ["place", "needle"]).groupBy(key, "rule", "product", "mode").agg(F.count("*").alias("_met")).join(needed, "rule")
    return met.where((F.col("mode") == "or") | (F.col("_met") == F.col("_needed"))).select(key, "product").distinct()


def _hits(responses: DataFrame, needles: dict[str, list[str]], key: str) -> DataFrame:
    """key, place and needle of what the ``needles`` of each place find."""

    @arrow_udf("array<struct<place: string, needle: string>>")
    def search(parts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        import ahocorasick

        machines = {}
        for place, words in needles.items():
            if words:
                machines[place] = ahocorasick.Automaton()
                for w in words:
                    machines[place].add_word(w, w)
                machines[place].make_automaton()
        kind = pa.list_(pa.struct([("place", pa.string()), ("needle", pa.string())]))
        for columns in parts:
            found: list[list[dict]] = [[] for _ in range(len(columns[0]))]
            for place, column in zip(PLACES, columns, strict=True):
                if place in machines:
                    for i, text in enumerate(column):
                        if low := (text.as_py() or "").lower():
                            found[i] += [{"place": place, "needle": w} for w in {w for _, w in machines[place].iter(low)}]
            yield pa.array(found, kind)

    return responses.select(key, F.explode(search(*PLACES)).alias("h")).select(key, "h.place", "h.needle")


# ---- rule files --------------------------------------------------------------------------------------------------

# Words that say nothing as the only keyword of a rule.
NOISY = frozenset((
    "login", "logout", "admin", "host", "hosts", "redirect", "support", "download", "theme", "platform", "console", "apps", "app", "user", "users", "auth", "register", "signin", "sign in", "sign-in", "manage", "dashboard",
    "settings", "config", "system", "main", "index", "home", "about", "help", "search", "version", "title", "test", "upload", "image", "file", "files", "name", "data", "icon", "shortcut icon", "login.php", "login.html", "login.jsp",
    "login.do", "login.action", "self.location", "self.location.href", "window.location", "window.location.href", "location.href", "360", "ie", "dns", "nas", "ip", "id", "ok", "login.aspx", "login.asp", "/login", "loginpage",
    "signup", "signout", "logout.php", "passwd", "password", "verify", "captcha", "robots.txt", "favicon.ico", "sitemap.xml", "manifest.json", "loading", "footer", "header", "content", "default", "welcome", "powered",
    "copyright", "service", "services", "products", "product", "company", "contact", "news", "blog", "forum",
))


def _criteria(df: DataFrame, product: str, *lists: tuple[str, str, Column]) -> DataFrame:
    """The rule table of ``df``; ``lists``: (mode, place, needles). A row's needles of one mode are one rule."""
    rule = lambda mode: F.xxhash64(F.to_json(F.struct(*df.columns)), F.lit(mode))

    def rows(mode: str, place: str, needles: Column) -> Column:
        return F.transform(F.coalesce(needles, F.array().cast("array<string>")), lambda n: F.struct(rule(mode).alias("rule"), F.lit(mode).alias("mode"), F.lit(place).alias("place"), F.lower(F.trim(n)).alias("needle")))

    out = df.select(F.col(product).alias("product"), F.explode(F.concat(*[rows(*x) for x in lists])).alias("c")).select("c.rule", "product", "c.mode", "c.place", "c.needle")
    return out.where("needle <> ''").distinct()


def read_hub_rules(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of {name, path, request_method, headers, keyword, favicon_hash}, as a rule table.

    Only rules for the front page by GET. All keywords and headers of an entry must be there (of a header its name and
    its value); one of its icon hashes is enough by itself.
    """
    kind = "name string, path string, request_method string, headers map<string,string>, keyword array<string>, favicon_hash array<string>"
    own = spark.read.schema(kind).json(path, multiLine=True)
    own = own.where(F.coalesce(F.trim("path"), F.lit("")).isin("", "/") & F.coalesce(F.lower(F.trim("request_method")), F.lit("")).isin("", "get"))
    headers = F.flatten(F.transform(F.map_entries("headers"), lambda e: F.array(F.concat(F.trim(e["key"]), F.lit(":")), F.coalesce(e["value"], F.lit("")))))
    return _criteria(own, "name", ("and", "body", F.col("keyword")), ("and", "header", headers), ("or", "favicon", F.col("favicon_hash")))


def read_keyword_rules(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object {fingerprint: [{cms, method, location, keyword}]}, as a rule table.

    All keywords must be in the place that is named (the body, if none is), or one of the icon hashes equal. A single
    keyword for the body must say something: not one of :data:`NOISY`, and eight characters long unless it is not ASCII.
    """
    kind = "fingerprint array<struct<cms: string, method: string, location: string, keyword: array<string>>>"
    own = spark.read.schema(kind).json(path, multiLine=True).select(F.inline("fingerprint"))
    words = F.filter(F.transform("keyword", lambda k: F.trim(k)), lambda k: k != "")
    own = own.select("cms", F.coalesce(F.lower(F.trim("method")), F.lit("")).alias("method"), F.coalesce(F.lower(F.trim("location")), F.lit("")).alias("location"), words.alias("words")).where("cms <> ''")
    one = F.lower(F.get("words", F.lit(0)))
    says = ~one.isin(*sorted(NOISY)) & ((F.octet_length(one) > F.char_length(one)) | (F.char_length(one) >= 8))
    by_word = F.col("method").isin("", "keyword")
    in_body = by_word & ~F.col("location").isin("header", "title") & ((F.size("words") != 1) | ~F.col("location").isin("", "body") | says)
    at = lambda which: F.when(which, F.col("words"))
    return _criteria(own, "cms", ("and", "body", at(in_body)), ("and", "header", at(by_word & (F.col("location") == "header"))), ("and", "title", at(by_word & (F.col("location") == "title"))), ("or", "favicon", at(F.col("method") == "faviconhash")))


def read_pattern_rules(spark: SparkSession, path: str) -> DataFrame:
    r"""A JSON object {apps: {name: {headers, cookies, html, script, scriptSrc, meta}}}, as (product, place, name, pattern).

    Patterns are regular expressions; what follows ``\;`` says how to read a version and goes. An empty pattern of a header
    asks for its presence. ``place`` is header (``name``: which), cookie or body.
    """
    app = "struct<headers: map<string,string>, cookies: map<string,string>, html: string, script: string, scriptSrc: string, meta: map<string,string>>"
    apps = spark.read.schema(f"apps map<string,{app}>").json(path, multiLine=True).select(F.explode("apps").alias("product", "a"))
    clean = lambda p: F.regexp_replace(F.coalesce(p, F.lit("")), r"(?s)(?:\\;|;version:|;confidence:).*$", "")
    many = lambda c: F.when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).when(c != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    row = lambda place, name, pattern: F.struct(F.lit(place).alias("place"), name.alias("name"), pattern.alias("pattern"))
    quoted = lambda k: F.regexp_replace(k, r"([^\w])", r"\\$1")
    none = F.lit("")
    heads = F.transform(F.map_entries("a.headers"), lambda e: row("header", F.lower(e["key"]), clean(e["value"])))
    cookies = F.transform(F.map_entries("a.cookies"), lambda e: row("cookie", none, F.concat(F.lit(r"\b"), quoted(e["key"]), F.lit("="), clean(e["value"]))))
    bodies = [F.transform(F.filter(many(F.col(f"a.{c}")), lambda p: clean(p) != ""), lambda p: row("body", none, clean(p))) for c in ("html", "script", "scriptSrc")]
    meta = F.flatten(F.transform(F.map_entries("a.meta"), lambda e: F.transform(many(e["value"]), lambda p: row("body", none, F.concat(F.lit(r"""<meta[^>]+name\s*=\s*["']"""), quoted(e["key"]), F.lit(r"""["'][^>]+content\s*=\s*["'][^"']*"""), clean(p))))))
    empty = F.array().cast("array<struct<place: string, name: string, pattern: string>>")
    parts = [F.coalesce(x.cast("array<struct<place: string, name: string, pattern: string>>"), empty) for x in (heads, cookies, *bodies, meta)]
    return apps.select("product", F.inline(F.concat(*parts)))


def matched_patterns(responses: DataFrame, patterns: DataFrame, key: str = "id", most: int = 200_000) -> DataFrame:
    """Distinct (key, product) of ``responses`` (key, headers: map, body, cookie) for which one of a product's patterns holds.

    A pattern runs only where a literal that it cannot match without was found; all literals are looked for at once. Patterns
    without one run on every row. Patterns go to the tasks ``most`` at a time, each part with a pass of its own. Case does
    not count; a pattern that is no regular expression here holds nowhere.
    """
    own = patterns.select("product", "place", "name", "pattern").distinct()
    parts = max(1, -(-own.count() // most))
    out = None
    for i in range(parts):
        part = own.where(F.pmod(F.xxhash64("product", "place", "name", "pattern"), F.lit(parts)) == i)
        one = _held(responses, [tuple(r) for r in part.collect()], key)  # at most about ``most``
        out = one if out is None else out.union(one)
    return out.distinct() if parts > 1 else out


class Patterns:
    """Patterns of products, by place and by the literals that they need.

    ``rows``: (product, place, name, pattern). Expressions are compiled when they first run.
    """

    def __init__(self, rows: Iterable[tuple[str, str, str, str]]):
        import ahocorasick

        # an expression is tried once for a text, whichever products and patterns have it
        own: dict[tuple[str, str, str], set[str]] = {}
        for product, place, name, pattern in rows:
            for way in literals.alternatives(pattern):
                own.setdefault((place, name, way), set()).add(product)
        self.rules: list[tuple[frozenset[str], str, str, str]] = []
        sames: dict[frozenset[str], frozenset[str]] = {}
        self.compiled: dict[str, Callable | None] = {}
        self.always: dict[str, list[int]] = {}
        sets = []
        for (place, name, pattern), products in own.items():
            try:
                sets.append(literals.needed(pattern) if pattern else [])
            except (re.error, RecursionError, OverflowError):
                continue
            of = frozenset(products)
            self.rules.append((sames.setdefault(of, of), place, name, pattern))
        # a literal that many patterns need says little: each goes by its rarest one
        common = Counter(w for some in sets for w in frozenset().union(*some))
        by_literal: dict[str, dict[str, list[int]]] = {}
        for n, some in enumerate(sets):
            place = self.rules[n][1]
            if not some:
                self.always.setdefault(place, []).append(n)
                continue
            for w in min(some, key=lambda s: (max(common[w] for w in s), -min(map(len, s)))):
                by_literal.setdefault(place, {}).setdefault(w, []).append(n)
        self.machines = {}
        for place, words in by_literal.items():
            machine = ahocorasick.Automaton()
            for w, of in words.items():
                machine.add_word(w, tuple(of))
            machine.make_automaton()
            self.machines[place] = machine

    def _holds(self, pattern: str, text: str) -> bool:
        if pattern not in self.compiled:
            try:
                self.compiled[pattern] = re.compile(pattern, re.I | re.S).search
            except (re.error, RecursionError, OverflowError):
                self.compiled[pattern] = None
        search = self.compiled[pattern]
        return search is not None and search(text) is not None

    def _candidates(self, place: str, text: str) -> set[int]:
        found = set(self.always.get(place, ()))
        if place in self.machines:
            for of in {of for _, of in self.machines[place].iter(literals.folded(text))}:
                found.update(of)
        return found

    def products(self, headers: dict[str, str], body: str, cookie: str) -> list[str]:
        """Products of which a pattern holds; ``headers`` by lower-case name."""
        seen: set[str] = set()
        for place, texts in (("header", headers), ("body", {"": body}), ("cookie", {"": cookie})):
            for name, text in texts.items():
                for n in self._candidates(place, text):
                    products, _, own, pattern = self.rules[n]
                    if not products <= seen and (place != "header" or own == name) and (not pattern or self._holds(pattern, text)):
                        seen |= products
        return sorted(seen)


#: The patterns that a worker's process searched for last: its next task need not build them anew.
_LAST: dict[str, Patterns] = {}


def _built(token: str, rows) -> Patterns:
    if token not in _LAST:
        _LAST.clear()
        _LAST[token] = Patterns(rows.value)
    return _LAST[token]


def _held(responses: DataFrame, rows: list[tuple[str, str, str, str]], key: str) -> DataFrame:
    """key and product of what the patterns ``rows`` find. An empty pattern asks for a header's presence and holds nowhere else."""
    shared, token = responses.sparkSession.sparkContext.broadcast([r for r in rows if r[3] or r[1] == "header"]), uuid.uuid4().hex

    @arrow_udf("array<string>")
    def search(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        patterns = _built(token, shared)
        for columns in batches:
            found = [patterns.products({k.lower(): v or "" for k, v in headers or ()}, body or "", cookie or "") for headers, body, cookie in zip(*(c.to_pylist() for c in columns), strict=True)]
            yield pa.array(found, pa.list_(pa.string()))

    return responses.select(key, F.explode(search("headers", "body", "cookie")).alias("product"))
