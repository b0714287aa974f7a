"""Sessions of assets as partitioned Parquet, and sinks."""

from __future__ import annotations

import io
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylight.model import COLUMNS, EXPORT, LISTS
from quarrylight.operators.normalize import compact_json, flat
from quarrylight.operators.report import SHEETS
from quarrylight.sources import workbooks


_LOG = "session_id long, name string, query string, targets string, notes string, assets long, created timestamp, gone boolean, at long"


class SessionStore:
    """``<root>/assets`` partitioned by session_id and is_raw, ``<root>/sessions``: a log of what is known of each session.

    A session's assets lie in directories of their own, so a load prunes to them. The log is only ever added to, a small
    file for each change, and a session's newest row holds: nothing is rewritten, so a crash loses nothing. Ids are
    claimed by creating a file that must not be there yet, so two savers never share one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def _sessions(self) -> DataFrame:
        """The newest row of each session that is not gone."""
        if not self._there(f"{self.root}/sessions"):
            return self.spark.createDataFrame([], _LOG).drop("gone", "at")
        log = self.spark.read.schema(_LOG).parquet(f"{self.root}/sessions")
        newest = log.groupBy("session_id").agg(F.max_by(F.struct(*[c for c in log.columns if c != "session_id"]), "at").alias("s")).select("session_id", "s.*")
        return newest.where(~F.col("gone")).drop("gone", "at")

    def _append(self, rows: DataFrame, gone: bool = False) -> None:
        rows.withColumn("gone", F.lit(gone)).withColumn("at", F.lit(time.time_ns())).coalesce(1).write.mode("append").parquet(f"{self.root}/sessions")

    def _claimed(self) -> int:
        p, fs = self._at(f"{self.root}/claims")
        fs.mkdirs(p)
        session = 1 + max((int(f.getPath().getName()) for f in fs.listStatus(p)), default=0)
        while True:
            try:
                fs.create(self._at(f"{self.root}/claims/{session}")[0], False).close()
                return session
            except Exception as e:  # taken by another saver in the meantime
                if "FileAlreadyExists" not in str(e) and "already exists" not in str(e):
                    raise
                session += 1

    def save(self, name: str, assets: DataFrame, raw: DataFrame | None = None, query: str = "", targets: str = "") -> int:
        session = self._claimed()
        for flag, df in ((0, assets), (1, raw)):
            if df is not None:
                df.select(*[c for c in COLUMNS if c in df.columns]).write.mode("overwrite").parquet(f"{self.root}/assets/session_id={session}/is_raw={flag}")
        n = self.load(session).count()
        self._append(self.spark.createDataFrame([(session, name, query, targets, "", n)], "session_id long, name string, query string, targets string, notes string, assets long").withColumn("created", F.current_timestamp()))
        return session

    def list(self) -> DataFrame:
        return self._sessions().orderBy(F.desc("session_id"))

    def load(self, session: int, raw: bool = False) -> DataFrame:
        """The merged assets, or the raw ones if they were kept."""
        at = f"{self.root}/assets/session_id={session}/is_raw="
        return self.spark.read.parquet(f"{at}1" if raw and self._there(f"{at}1") else f"{at}0")

    def set_notes(self, session: int, notes: str) -> None:
        self._append(self._sessions().where(F.col("session_id") == session).withColumn("notes", F.lit(notes)))

    def delete(self, session: int) -> None:
        """The session and its assets."""
        self._append(self._sessions().where(F.col("session_id") == session), gone=True)
        p, fs = self._at(f"{self.root}/assets/session_id={session}")
        fs.delete(p, True)


def write_csv(assets: DataFrame, path: str, bom: bool = False) -> None:
    """The export's columns, lists joined by commas, missing values empty."""
    out = assets.select(*flat())
    if bom:
        first = EXPORT[0]
        out = out.withColumnRenamed(first, f"﻿{first}")
    out.write.mode("overwrite").csv(path, header=True, escape='"', nullValue="", emptyValue="")


def write_json(assets: DataFrame, path: str) -> None:
    """A JSON object for each asset, without missing values."""
    assets.select(compact_json(assets).alias("value")).write.mode("overwrite").text(path)


def write_text(assets: DataFrame, path: str, column: str = "host") -> None:
    assets.select(F.col(column).cast("string").alias("value")).where("value IS NOT NULL").write.mode("overwrite").text(path)


def write_yaml(assets: DataFrame, path: str) -> None:
    """A YAML sequence: scalars quoted, lists as flow sequences."""
    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c.cast("string"), r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    lines = []
    for c in (c for c in EXPORT if c in assets.columns):
        value = F.concat(F.lit("["), F.array_join(F.transform(c, quote), ", "), F.lit("]")) if c in LISTS else quote(F.col(c))
        lines.append(F.concat(F.lit(f"  {c}: "), value))
    assets.select(F.concat(F.lit("-\n"), F.concat_ws("\n", *lines)).alias("value")).write.mode("overwrite").text(path)


def write_report(assets: DataFrame, path: str, form: str = "parquet", names: tuple[str, ...] = tuple(SHEETS)) -> list[str]:
    """A folder for each sheet. No sheet is left out of large reports: none is held in memory."""
    for n in names:
        writer = SHEETS[n](assets).write.mode("overwrite")
        writer.csv(f"{path}/{n}", header=True, escape='"') if form == "csv" else writer.parquet(f"{path}/{n}")
    return [f"{path}/{n}" for n in names]


class _Sink(io.RawIOBase):
    """A file of the Hadoop file system to write bytes to."""

    def __init__(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)

    def writable(self) -> bool:
        return True

    def write(self, b) -> int:
        self.out.write(bytearray(b))
        return len(b)

    def close(self) -> None:
        if not self.closed:
            self.out.close()
        super().close()


def sink(spark: SparkSession, path: str) -> io.RawIOBase:
    """A new file at ``path``, in whichever file system it is."""
    return _Sink(spark, path)


def write_workbook(assets: DataFrame, path: str, names: tuple[str, ...] = tuple(SHEETS), sheet_rows: int = workbooks.SHEET_ROWS) -> list[str]:
    """One XLSX workbook with a sheet for each name; its sheets' names.

    Tasks make and compress the XML; the driver puts the compressed pieces together. Sheets that are longer than the format
    allows go on in further ones.
    """
    return workbooks.write_sheets({n: SHEETS[n](assets) for n in names}, path, _Sink(assets.sparkSession, path), sheet_rows)


def export(assets: DataFrame, path: str) -> None:
    """By the path's ending."""
    kind = path.rsplit(".", 1)[-1].lower()
    writers = {"csv": write_csv, "json": write_json, "yaml": write_yaml, "yml": write_yaml, "txt": write_text, "xlsx": write_workbook, "parquet": lambda a, p: a.write.mode("overwrite").parquet(p)}
    if kind not in writers:
        raise ValueError(f"no writer for {kind!r}")
    writers[kind](assets, path)
