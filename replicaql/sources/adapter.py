"""Adapters as a Spark data source: spark.read.format("replica") reads what an adapter class holds, and readStream its change log.

An adapter says what columns a target has, into which parts its rows are cut, and how a part is read; filters that it can answer
are pushed to it, and Spark applies the others. ParquetAdapter, for tables as Parquet files, is one; others are given by the option adapter
("package.module:Class"). Spark pushes filters only where spark.sql.python.filterPushdown.enabled is true (pushdown()) and refuses a reader that
takes them elsewhere: there, set the option pushdown to false.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from importlib import import_module
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyspark.sql import SparkSession
from pyspark.sql import datasource as s
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from ..errors import SourceError

FORMAT, SETTING = "replica", "spark.sql.python.filterPushdown.enabled"


@dataclass(frozen=True)
class Part(s.InputPartition):
    """A part of an adapter's rows: something that it can find them by again."""

    place: Any


class Adapter:
    """What a user writes for a store of theirs. options: those of the reader, names in lower case."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def schema(self, target: str) -> StructType:
        """The columns of a target, local or remote."""
        raise NotImplementedError

    def parts(self) -> list[Any]:
        raise NotImplementedError

    def answers(self, test: s.Filter) -> bool:
        """Whether read() applies this filter."""
        return False

    def read(self, part: Any, columns: list[str], tests: list[s.Filter]) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def latest(self) -> int:
        """The number of the last change; 0 before the first."""
        raise SourceError(f"{type(self).__name__} has no change log")

    def changes(self, after: int, upto: int) -> list[Any]:
        """The parts that hold the changes with numbers in between."""
        raise SourceError(f"{type(self).__name__} has no change log")


def _expression(test: s.Filter) -> pc.Expression | None:
    """A pushed filter for Arrow, or None if it has none."""
    name = getattr(test, "attribute", ())
    field = pc.field(*name) if name else None
    match test:
        case s.EqualTo():
            return field == test.value
        case s.GreaterThan():
            return field > test.value
        case s.GreaterThanOrEqual():
            return field >= test.value
        case s.LessThan():
            return field < test.value
        case s.LessThanOrEqual():
            return field <= test.value
        case s.In():
            return field.isin(list(test.value))
        case s.IsNull():
            return field.is_null()
        case s.IsNotNull():
            return field.is_valid()
        case s.StringStartsWith():
            return pc.starts_with(field, test.value)
        case s.StringEndsWith():
            return pc.ends_with(field, test.value)
        case s.StringContains():
            return pc.match_substring(field, test.value)
        case s.Not():
            child = _expression(test.child)
            return None if child is None else ~child
    return None


class ParquetAdapter(Adapter):
    """Parquet files: path, and for a target hidden columns (hidden_local, hidden_remote; comma-separated). The change log is the folder changes, a
    file of a number (00000007.parquet) for each batch of changes."""

    def _dataset(self, path: str) -> ds.Dataset:
        return ds.dataset(path.removeprefix("file://"), format="parquet")

    def schema(self, target: str) -> StructType:
        hidden = [c for c in self.options.get(f"hidden_{target}", "").split(",") if c]
        path = self.options.get("changes") if target == "changes" else self.options["path"]
        whole = self._dataset(path).schema
        return from_arrow_schema(pa.schema([f for f in whole if f.name not in hidden]), prefer_timestamp_ntz=True)

    def parts(self) -> list[Any]:
        """One for each group of rows of a file."""
        return [(f.path, i) for f in self._dataset(self.options["path"]).get_fragments() for i in range(f.num_row_groups)]

    def answers(self, test: s.Filter) -> bool:
        return _expression(test) is not None

    def read(self, part: Any, columns: list[str], tests: list[s.Filter]) -> Iterator[pa.RecordBatch]:
        path, group = part
        fragment = next(iter(self._dataset(path).get_fragments()))
        chosen = fragment if group is None else fragment.subset(row_group_ids=[group])
        wanted = None
        for test in tests:
            wanted = _expression(test) if wanted is None else wanted & _expression(test)
        yield from chosen.to_batches(columns=columns, filter=wanted)

    def _numbered(self) -> dict[int, str]:
        files = [f.path for f in self._dataset(self.options["changes"]).get_fragments()]
        return {int(p.rpartition("/")[2].split(".")[0]): p for p in files}

    def latest(self) -> int:
        return max(self._numbered(), default=0)

    def changes(self, after: int, upto: int) -> list[Any]:
        return [(p, None) for n, p in sorted(self._numbered().items()) if after < n <= upto]


def _cast(batches: Iterable[pa.RecordBatch], schema: StructType) -> Iterator[pa.RecordBatch]:
    kinds = to_arrow_schema(schema)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(f.name).cast(f.type) for f in kinds], schema=kinds)


class _Reader(s.DataSourceReader):
    def __init__(self, adapter: Adapter, schema: StructType):
        self.adapter, self.kinds, self.tests = adapter, schema, []

    def partitions(self) -> list[Part]:
        return [Part(p) for p in self.adapter.parts()] or [Part(None)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if partition.place is not None:
            yield from _cast(self.adapter.read(partition.place, self.kinds.names, self.tests), self.kinds)


class _PushingReader(_Reader):
    def pushFilters(self, filters: list[s.Filter]) -> Iterable[s.Filter]:
        for f in filters:
            if self.adapter.answers(f):
                self.tests.append(f)
            else:
                yield f


class _Changes(s.DataSourceStreamReader):
    def __init__(self, adapter: Adapter, schema: StructType):
        self.adapter, self.kinds = adapter, schema

    def initialOffset(self) -> dict:
        return {"change": 0}

    def latestOffset(self) -> dict:
        return {"change": self.adapter.latest()}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(p) for p in self.adapter.changes(start["change"], end["change"])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from _cast(self.adapter.read(partition.place, self.kinds.names, []), self.kinds)


class ReplicaSource(s.DataSource):
    """Options: path and others of the adapter; adapter; target (local by default; changes for a stream); pushdown (true by default)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    @property
    def _adapter(self) -> Adapter:
        module, _, name = self.options.get("adapter", f"{__name__}:ParquetAdapter").partition(":")
        return getattr(import_module(module), name)({k.lower(): v for k, v in self.options.items()})

    def schema(self) -> StructType:
        return self._adapter.schema(self.options.get("target", "local"))

    def reader(self, schema: StructType) -> s.DataSourceReader:
        return (_Reader if self.options.get("pushdown") == "false" else _PushingReader)(self._adapter, schema)

    def streamReader(self, schema: StructType) -> s.DataSourceStreamReader:
        return _Changes(self._adapter, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ReplicaSource)


@contextmanager
def pushdown(spark: SparkSession):
    """Filters are pushed to adapters in queries that are planned within; the session's own setting comes back after."""
    before = spark.conf.get(SETTING, None)
    spark.conf.set(SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(SETTING, before) if before is not None else spark.conf.unset(SETTING)
