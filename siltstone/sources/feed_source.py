"""The change feed as a Spark data source: `spark.read.format("siltstone_feed")`, and as a stream whose offset is the feed's position.

The log is a folder of Parquet files with a `position`.  A stream starts after any cursor, goes on after a restart where
its checkpoint says, and sees late events when they are published, since these get later positions.  Files' footers tell
which positions they hold, so that a batch reads only the row groups of its own stretch, in as many tasks as there are files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def _files(folder: str) -> list[str]:
    from pyarrow import fs

    store, path = _open(folder)
    return sorted(x.path for x in store.get_file_info(fs.FileSelector(path, recursive=True)) if x.base_name.endswith(".parquet") and not x.base_name.startswith(("_", ".")))


@dataclass
class Stretch(InputPartition):
    """Positions (after, upto] of one file."""

    file: str
    after: int
    upto: int


class _Log:
    """What readers share: the folder, its schema, and what its files' footers say."""

    def __init__(self, schema: StructType, options: dict):
        if "path" not in options:
            raise ValueError("the feed needs a path")
        self.schema, self.folder = schema, options["path"]
        self.cursor = int(options.get("cursor", 0))
        self.at_most = int(options["maxevents"]) if "maxevents" in options else None
        self._spans: dict[str, tuple[int, int] | None] = {}

    def spans(self) -> dict[str, tuple[int, int]]:
        """The least and greatest position of every file; a file is looked into once."""
        import pyarrow.parquet as pq

        store, _ = _open(self.folder)
        for file in _files(self.folder):
            if file not in self._spans:
                with store.open_input_file(file) as f:
                    told = pq.ParquetFile(f)
                    place = told.schema_arrow.get_field_index("position")
                    held = [told.metadata.row_group(i).column(place).statistics for i in range(told.metadata.num_row_groups)]
                    self._spans[file] = (min(s.min for s in held), max(s.max for s in held)) if held else None
        return {k: v for k, v in self._spans.items() if v}

    def head(self) -> int:
        return max((hi for _, hi in self.spans().values()), default=0)

    def stretches(self, after: int, upto: int) -> list[Stretch]:
        return [Stretch(file, after, upto) for file, (lo, hi) in sorted(self.spans().items()) if hi > after and lo <= upto]

    def events(self, part: Stretch):
        """The events of a stretch as Arrow batches, from the row groups that hold some."""
        import pyarrow.compute as pc
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        wanted = to_arrow_schema(self.schema)
        with _open(self.folder)[0].open_input_file(part.file) as f:
            held = pq.ParquetFile(f)
            place = held.schema_arrow.get_field_index("position")
            groups = [i for i in range(held.metadata.num_row_groups) if (s := held.metadata.row_group(i).column(place).statistics).max > part.after and s.min <= part.upto]
            for batch in held.iter_batches(row_groups=groups, columns=[x.name for x in self.schema]) if groups else ():
                at = batch.column(batch.schema.get_field_index("position"))
                mine = batch.filter(pc.and_(pc.greater(at, part.after), pc.less_equal(at, part.upto)))
                if mine.num_rows:
                    yield type(batch).from_arrays([mine.column(mine.schema.get_field_index(x.name)).cast(x.type) for x in wanted], schema=wanted)


class _Batch(DataSourceReader):
    def __init__(self, log: _Log):
        self.log = log

    def partitions(self):
        return self.log.stretches(self.log.cursor, self.log.head()) or [Stretch("", 0, 0)]

    def read(self, partition):
        return self.log.events(partition) if partition.file else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, log: _Log):
        self.log, self.told = log, None

    def initialOffset(self) -> dict:
        return {"position": self.log.cursor}

    def latestOffset(self) -> dict:
        # With a bound on a batch's events, offsets go on from the last one told or planned.
        head = self.log.head()
        if self.log.at_most is not None:
            last = self.log.cursor if self.told is None else self.told
            head = min(head, last + self.log.at_most)
        self.told = max(head, self.told or 0)
        return {"position": self.told}

    def partitions(self, start: dict, end: dict):
        self.told = max(self.told or 0, end["position"])
        return self.log.stretches(start["position"], end["position"]) or [Stretch("", 0, 0)]

    def read(self, partition):
        return self.log.events(partition) if partition.file else iter(())

    def commit(self, end: dict) -> None:
        self.told = max(self.told or 0, end["position"])


class Feed(DataSource):
    """Options: path, cursor (events after it; 0), maxEvents (positions a micro-batch takes at most; all)."""

    @classmethod
    def name(cls) -> str:
        return "siltstone_feed"

    def schema(self):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import from_arrow_schema

        files = _files(self.options["path"])
        if not files:
            raise ValueError("the feed has no file yet: give its schema")
        with _open(self.options["path"])[0].open_input_file(files[0]) as f:
            return from_arrow_schema(pq.ParquetFile(f).schema_arrow)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(_Log(schema, self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(_Log(schema, self.options))


def register(spark) -> None:
    spark.dataSource.register(Feed)
