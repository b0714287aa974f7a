"""Imports of other tools' exports and of target lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.model import COLUMNS, EXPORT, LISTS, as_assets
from quarrylight.operators.filters import target_list
from quarrylight.operators.normalize import normalized
from quarrylight.sources import workbooks

# The exports' headers. A tuple: the first that is there and not empty.
FOFA = {
    "ip": ("IP",), "port": ("端口",), "protocol": ("协议", "基础协议"), "domain": ("域名",), "host": ("主机名",), "url": ("链接",), "service": ("服务",), "title": ("标题",),
    "os": ("操作系统",), "country": ("国家", "国家代码"), "province": ("区域",), "city": ("城市",), "asn": ("ASN",), "org": ("组织",), "cert_subject": ("证书持有者CN", "证书持有者组织"),
    "cert_issuer": ("证书颁发者CN", "证书颁发者组织"), "jarm": ("JARM",), "ja3s": ("JA3S",), "icp": ("ICP备案号",), "update_time": ("更新时间",),
}
FOFA_RAW = ("HEADER", "BANNER", "CNAME", "证书")
QUAKE = {
    "ip": ("IP",), "port": ("端口",), "protocol": ("传输协议", "服务"), "domain": ("域名",), "host": ("主机名",), "url": ("链接",), "service": ("服务",), "title": ("网页标题",), "server": ("服务器",),
    "country": ("国家中文", "国家英文", "国家代码"), "province": ("省份中文", "省份英文"), "city": ("城市中文", "城市英文"), "asn": ("自治域编号",), "org": ("自治域名称", "自治域"), "isp": ("运营商",),
    "icp": ("备案号",), "jarm": ("JARM指纹",), "ja3s": ("JA3S指纹",), "favicon_hash": ("FAVICON指纹",), "update_time": ("更新时间",),
}
QUAKE_RAW = ("响应头", "内容", "网站路径", "HTML指纹", "GPS坐标")


def whole_number(c: Column) -> Column:
    """A number written as ``8080`` or ``8080.0``."""
    t = F.trim(c)
    return F.coalesce(t.try_cast("int"), t.try_cast("double").try_cast("int"))


def filled(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of the columns that is there and not empty, trimmed."""
    there = [F.nullif(F.trim(df[n].cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def _assets(df: DataFrame, fields: Mapping[str, Sequence[str]], raw: Sequence[str], source: str, more: Mapping[str, Column]) -> DataFrame:
    own = {c: filled(df, names) for c, names in fields.items()}
    own["port"] = whole_number(own["port"])
    entries = [F.when(filled(df, (n,)).isNotNull(), F.struct(F.lit(n).alias("key"), filled(df, (n,)).alias("value"))) for n in raw if n in df.columns]
    extra = F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.lit(None).cast("map<string,string>")
    seq = F.col("seq") if "seq" in df.columns else F.monotonically_increasing_id()
    out = df.select(*[c.alias(n) for n, c in {**own, **more}.items()], extra.alias("raw"), F.lit(source).alias("source"), seq.alias("seq"))
    return normalized(as_assets(out)).where(F.coalesce("host", "domain", "url", "ip").isNotNull())


def from_fofa(rows: DataFrame) -> DataFrame:
    """Products ``[{class name}]`` and certificate names ``['a', 'b']`` become lists."""
    products = F.regexp_extract_all(filled(rows, ("产品名",)), F.lit(r"\{[^{}]*?\s+([^{}\s][^{}]*?)\s*\}"), F.lit(1))
    names = F.transform(F.split(F.btrim(filled(rows, ("证书域名",)), F.lit("[]")), ","), lambda v: F.btrim(F.trim(v), F.lit("'\"")))
    return _assets(rows, FOFA, FOFA_RAW, "fofa_xlsx", {"products": products, "cert_domains": F.filter(names, lambda v: v != "")})


def from_quake(rows: DataFrame) -> DataFrame:
    """The system's name and version are joined, components are a list, the certificate is cut at 200 characters."""
    parts = F.split(F.replace(F.btrim(filled(rows, ("组件",)), F.lit("[]")), F.lit("|"), F.lit(",")), ",")
    os = F.nullif(F.trim(F.concat_ws(" ", filled(rows, ("操作系统",)), filled(rows, ("操作系统版本",)))), F.lit(""))
    more = {"os": os, "cert_subject": F.substring(filled(rows, ("证书",)), 1, 200), "products": F.filter(F.transform(parts, lambda v: F.trim(v)), lambda v: v != "")}
    return _assets(rows, QUAKE, QUAKE_RAW, "quake_xlsx", more)


def split_list(c: Column) -> Column:
    """A list in one cell, split at the first of ``; | ， ,`` that it has."""
    parts = F.when(c.contains(";"), F.split(c, ";")).when(c.contains("|"), F.split(c, r"\|")).when(c.contains("，"), F.split(c, "，")).otherwise(F.split(c, ","))
    return F.filter(F.transform(parts, lambda v: F.trim(v)), lambda v: v != "")


def from_own_export(rows: DataFrame, least: int = 5) -> DataFrame | None:
    """Rows of an export of this library; None if fewer than ``least`` of its headers are there."""
    known = [c for c in EXPORT if c in rows.columns]
    if len(known) < least:
        return None
    own = [split_list(filled(rows, (c,))).alias(c) if c in LISTS else whole_number(F.col(c)).alias(c) if c == "port" else filled(rows, (c,)).alias(c) for c in known]
    seq = F.col("seq") if "seq" in rows.columns else F.monotonically_increasing_id()
    out = as_assets(rows.select(*own, seq.alias("seq")))
    return normalized(out.withColumn("source", F.coalesce("source", F.lit("recon_xlsx")))).where(F.coalesce("host", "domain", "url", "ip").isNotNull())


def detect(columns: Sequence[str]) -> str:
    """'own', 'quake' or 'fofa' by the headers that are there."""
    if len(set(columns) & set(EXPORT)) >= 5:
        return "own"
    scores = {"quake": {"网页标题", "组件", "传输协议", "备案号"}, "fofa": {"标题", "产品名", "协议", "ICP备案号"}}
    return max(scores, key=lambda k: len(scores[k] & set(columns)))


def imported(rows: DataFrame) -> DataFrame:
    kind = detect(rows.columns)
    return {"own": from_own_export, "quake": from_quake, "fofa": from_fofa}[kind](rows)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheets of the workbooks at ``path`` as strings, headers from the first row of the first one; ranges of rows are read in tasks of their own."""
    rows = workbooks.read_rows(spark, path, sheets="first")
    head = rows.where("row = 1").orderBy("file").limit(1).collect()
    names = [c.strip() or f"_{i}" for i, c in enumerate(head[0]["cells"])] if head else []
    return rows.where("row > 1").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)], (F.col("row") - 2).alias("seq"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, column, value) of every cell of CSV files; rows may differ in length, quotes may stand anywhere. A file is streamed by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).select("path")

    def cells(batches):
        import csv
        import io

        import pyarrow as pa

        for b in batches:
            for file in b.column(0).to_pylist():
                with workbooks.opened(file) as raw, io.TextIOWrapper(raw, encoding="utf-8-sig", errors="replace", newline="") as text:
                    held = []
                    for n, row in enumerate(csv.reader(text), 1):
                        held += [(file, n, i, v) for i, v in enumerate(row) if v.strip()]
                        if len(held) >= 10_000:
                            yield _cells_batch(held)
                            held = []
                    if held:
                        yield _cells_batch(held)

    def _cells_batch(held):
        import pyarrow as pa

        file, row, column, value = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(file), pa.array(row, pa.int64()), pa.array(column, pa.int32()), pa.array(value)], names=["file", "row", "column", "value"])

    return files.mapInArrow(cells, "file string, row long, column int, value string")


def read_targets(spark: SparkSession, path: str) -> DataFrame:
    """Distinct targets of files, each at its first place.

    Of workbooks (.xlsx) and CSV files (.csv) every cell is one, trimmed. Other files are text: lines split at commas,
    semicolons, white space; ``#`` starts a comment. A path is one file or a folder of one kind of files.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "csv"):
        cells = workbooks.read_cells(spark, path).select("file", "sheet", "row", "column", "value") if kind == "xlsx" else csv_cells(spark, path).select("file", F.lit("").alias("sheet"), "row", "column", "value")
        first = cells.select(F.trim("value").alias("target"), F.struct("file", "sheet", "row", "column").alias("at")).where("target <> ''").groupBy("target").agg(F.min("at").alias("at"))
        return first.select("target", F.col("at.row").alias("line"), F.col("at.column").alias("at"))
    lines = spark.read.text(path).select(F.regexp_replace("value", r"(^|\s)#.*$", "").alias("line"), F.monotonically_increasing_id().alias("seq"))
    return target_list(lines)


__all__ = ["COLUMNS", "detect", "from_fofa", "from_own_export", "from_quake", "imported", "csv_cells", "read_csv", "read_targets", "read_xlsx", "whole_number"]
