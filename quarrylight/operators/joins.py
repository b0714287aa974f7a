"""Joins that the relation needs: addresses to prefixes, shared fingerprints, wildcard answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylight.functions.bind import bound
from quarrylight.functions.classify import ipv4_number
from quarrylight.functions.text import certificate_orgs, trackers
from quarrylight.functions.web import wildcard_answer


def prefix_join(addresses: DataFrame, prefixes: DataFrame, ip: str = "ip", prefix: str = "prefix") -> DataFrame:
    """``addresses`` with the longest of ``prefixes`` (a.b.c.d/n or of IPv6) that holds each; rows without one stay.

    An address is two longs, an IPv4 one being among ``::ffff:0:0/96``. It has one network for each prefix length in use
    (129 at most, of which an address of either family tries its own), so containment is an equi-join on (length, network):
    no nested loop, whatever the sizes. A prefix written twice counts once.
    """
    nets = prefixes.withColumn("_n", ip_number(F.regexp_extract(prefix, "^([^/]+)", 1))).withColumn("_len", F.regexp_extract(prefix, r"/(\d+)$", 1).try_cast("int") + F.when(F.col(prefix).contains(":"), 0).otherwise(96))
    nets = nets.where("_n IS NOT NULL AND _len BETWEEN 0 AND 128").select("*", *_network(F.col("_n"), F.col("_len")))
    lengths = sorted(r["_len"] for r in nets.select("_len").distinct().collect())  # 129 at most
    if not lengths:
        return addresses.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in prefixes.schema.fields if f.name not in addresses.columns])
    own = addresses.select(ip).where(F.col(ip).isNotNull()).distinct().withColumn("_n", ip_number(F.col(ip)))
    tried = F.filter(F.lit(lengths), lambda x: F.col(ip).contains(":") | (x >= 96))
    offers = own.where("_n IS NOT NULL").select(ip, "_n", F.explode(tried).alias("_len")).select(ip, "_len", *_network(F.col("_n"), F.col("_len")))
    best = offers.join(nets, ["_len", "_hi", "_lo"]).groupBy(ip).agg(F.max_by(F.struct(*prefixes.columns), "_len").alias("_best")).select(ip, "_best.*")
    return addresses.join(best, ip, "left")


def ip_number(c: Column) -> Column:
    """struct<hi, lo> of an address of either family, the bits of 128 in two longs; null for anything else."""
    return bound(F.lower(F.trim(c)), lambda b: F.when(b.contains(":"), _ipv6_number(b)).otherwise(_ipv4_mapped(b)))


def _pair(hi: Column, lo: Column) -> Column:
    return F.struct(hi.cast("long").alias("hi"), lo.cast("long").alias("lo"))


def _ipv4_mapped(text: Column) -> Column:
    return bound(ipv4_number(text), lambda n: F.when(n.isNotNull(), _pair(F.lit(0), n.bitwiseOR(F.lit(0xFFFF << 32)))))


def _ipv6_number(text: Column) -> Column:
    tail = r"^[0-9a-f:]*:(\d+\.\d+\.\d+\.\d+)$"  # a dotted end is two groups
    four = lambda n: F.concat(F.regexp_extract(text, r"^(.*:)[^:]*$", 1), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(65535)))))
    spelt = F.when(text.contains("."), bound(ipv4_number(F.regexp_extract(text, tail, 1)), four)).otherwise(text)
    groups = lambda s: F.filter(F.split(F.coalesce(s, F.lit("")), ":"), lambda g: g != "")

    def whole(t: Column, sides: Column) -> Column:
        """The eight groups; null if there are not as many, a gap being one or more of them."""
        return bound(
            F.struct(groups(F.get(sides, F.lit(0))).alias("a"), groups(F.get(sides, F.lit(1))).alias("z"), F.size(sides).alias("n")),
            lambda s: F.when(
                t.rlike(r"^[0-9a-f:]+$") & ~t.rlike(":::|^:[^:]|[^:]:$|[0-9a-f]{5}") & ((s["n"] == 2) & (F.size(s["a"]) + F.size(s["z"]) <= 7) | (s["n"] == 1) & (F.size(s["a"]) == 8)),
                F.concat(s["a"], F.array_repeat(F.lit("0"), 8 - F.size(s["a"]) - F.size(s["z"])), s["z"]),
            ),
        )

    half = lambda g, at: F.aggregate(F.slice(g, at, 4), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 16).bitwiseOR(F.conv(x, 16, 10).cast("long")))
    return bound(spelt, lambda t: bound(whole(t, F.split(t, "::")), lambda g: F.when(g.isNotNull(), _pair(half(g, 1), half(g, 5)))))


def _network(number: Column, length: Column) -> tuple[Column, Column]:
    """``_hi`` and ``_lo``: the first ``length`` of 128 bits, the others 0."""

    def masked(value: Column, bits: Column) -> Column:
        return F.when(bits <= 0, F.lit(0).cast("long")).when(bits >= 64, value).otherwise(value.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("long"), 64 - bits)))

    return masked(number["hi"], length).alias("_hi"), masked(number["lo"], length - 64).alias("_lo")


def fingerprints(assets: DataFrame) -> DataFrame:
    """Distinct (host, kind, value) of what ties hosts to an owner: licence number, certificate organisation, icon, trackers."""
    names = F.coalesce(F.try_element_at("raw", F.lit("cert")), F.concat(F.lit("O="), F.col("cert_subject")))
    parts = {
        "icp": F.array("icp"),
        "cert_org": certificate_orgs(names),
        "icon_hash": F.array(F.when(~F.col("favicon_hash").isin("0", "None"), F.col("favicon_hash"))),
        "tracker": trackers(F.concat_ws(" ", F.try_element_at("raw", F.lit("banner")), F.try_element_at("raw", F.lit("body")))),
    }
    pairs = F.concat(*[_pairs(k, v) for k, v in parts.items()])
    out = assets.select(F.coalesce("host", "domain", "ip").alias("host"), F.explode(pairs).alias("p")).select("host", "p.kind", "p.value")
    return out.where("host IS NOT NULL AND value IS NOT NULL AND value <> ''").distinct()


def _pairs(kind: str, values):
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))


def sharing(prints: DataFrame, targets: DataFrame) -> DataFrame:
    """(host, kind, value) of hosts outside ``targets`` (host) with a fingerprint that one of ``targets`` has."""
    wanted = prints.join(targets.select("host").distinct(), "host", "left_semi").select("kind", "value").distinct()
    return prints.join(wanted, ["kind", "value"], "left_semi").join(targets.select("host").distinct(), "host", "left_anti").select("host", "kind", "value")


def without_wildcards(answers: DataFrame, wildcards: DataFrame) -> DataFrame:
    """DNS answers (name, parent, ips, cname) that no wildcard of their parent (parent, ips, cname) gives too. A parent may have any number."""
    w = wildcards.select(F.col("parent").alias("_parent"), F.col("ips").alias("_ips"), F.col("cname").alias("_cname"))
    same = F.coalesce(wildcard_answer(F.col("ips"), F.col("_ips"), F.col("cname"), F.col("_cname")), F.lit(False))
    return answers.join(w, (F.col("parent") == F.col("_parent")) & same, "left_anti")
