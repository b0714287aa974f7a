"""An event log as a stream whose offsets are the log's own cursor: the number of the last event that was taken.

A restart from a checkpoint goes on behind it, whichever files the log lies in by then (they may be rewritten or merged in the
meantime). Numbers must ascend as events arrive: what appears below the cursor later is not seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _dataset(path: str):
    import pyarrow.dataset as ds
    from pyarrow import fs

    path = re.sub("^file:/*", "/", path) if path.startswith("file:") else path
    if "://" in path:
        store, at = fs.FileSystem.from_uri(path)
        return ds.dataset(at, filesystem=store, format="parquet")
    return ds.dataset(path, format="parquet")


#: Rows of a piece of a row group.
BATCH = 16_384


class _Slice(InputPartition):
    def __init__(self, first: int, last: int):
        super().__init__((first, last))


class _CursorReader(DataSourceStreamReader):
    def __init__(self, path: str, order: str, since: int, slices: int, columns: list[str]):
        self.path, self.order, self.since, self.slices, self.columns = path, order, since, slices, columns

    def initialOffset(self) -> dict:
        return {"cursor": self.since}

    def latestOffset(self) -> dict:
        """The largest number, from the footers of the files: no row is read."""
        last = self.since
        for f in _dataset(self.path).get_fragments():
            at = f.metadata.schema.to_arrow_schema().get_field_index(self.order)
            for g in range(f.metadata.num_row_groups):
                stats = f.metadata.row_group(g).column(at).statistics
                if stats is not None and stats.has_min_max:
                    last = max(last, stats.max)
        return {"cursor": last}

    def partitions(self, start: dict, end: dict) -> list[_Slice]:
        first, last = start["cursor"] + 1, end["cursor"]
        each = max(1, -(-(last - first + 1) // self.slices))
        return [_Slice(a, min(a + each - 1, last)) for a in range(first, last + 1, each)]

    def read(self, partition: _Slice) -> Iterator:
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        first, last = partition.value
        dataset, order = _dataset(self.path), pc.field(self.order)
        wanted = (order >= first) & (order <= last)
        columns = list(dict.fromkeys([*self.columns, self.order]))
        # row groups without such numbers are not read; others page by page, nothing ahead: a log may be one large row group
        for fragment in dataset.get_fragments(filter=wanted):
            groups = [g.id for g in fragment.subset(wanted).row_groups]
            with fragment.filesystem.open_input_file(fragment.path) as source:
                file = pq.ParquetFile(source, pre_buffer=False, buffer_size=1 << 20)
                for batch in file.iter_batches(BATCH, row_groups=groups, columns=columns, use_threads=False):
                    if (part := batch.filter(wanted)).num_rows:
                        yield part.select(self.columns)

    def commit(self, end: dict) -> None:
        pass


class CursorLog(DataSource):
    """Options: ``path`` of Parquet files, ``order`` (the number's column), ``since`` (the cursor to begin behind), ``slices`` of a micro-batch."""

    @classmethod
    def name(cls) -> str:
        return "cursor_log"

    def schema(self) -> StructType:
        from pyspark.sql.pandas.types import from_arrow_schema

        return from_arrow_schema(_dataset(self.options["path"]).schema)

    def streamReader(self, schema: StructType) -> _CursorReader:
        return _CursorReader(self.options["path"], self.options.get("order", "event_id"), int(self.options.get("since", "-1")), int(self.options.get("slices", "8")), schema.fieldNames())


def cursor_stream(spark: SparkSession, path: str, since: int = -1, order: str = "event_id", slices: int = 8) -> DataFrame:
    """Events behind the cursor ``since``, and from then on what arrives."""
    spark.dataSource.register(CursorLog)
    return spark.readStream.format("cursor_log").option("path", path).option("order", order).option("since", str(since)).option("slices", str(slices)).load()
