"""The payload layouts as one data source: ``spark.read.format("payload")``.

    register(spark)
    rows = (
        spark.read.format("payload").option("path", folder).option("layout", "json_array").load()
        .filter("series_id = 'selic' AND data >= DATE '2015-01-01'")
    )

A folder holds ``series_id=<id>`` folders, and in these the files, either at once or in
``window=<first day>_<last day>`` folders, as a backfill by windows leaves them. A filter on
``series_id`` or ``data`` is applied to the folders' names before any file is opened, and by
Spark to the rows. A file is one partition; a window's folder promises the days of its rows,
and a row outside of them fails the job.

Layouts: ``json_array``, ``json_sentinel``, ``json_nested``, ``csv_wide`` give LONG rows, and
``survey`` the columns of ``payloads.read_survey``, whose ``ref`` is an option here too and
whose ``data`` filter goes by ``survey_date``. Dates and numbers are read, and errors raised,
as by the readers in ``payloads``, which remain the faster way to read whole folders of large
files: they parse in the JVM and split them. Paths are any that ``pyarrow.fs`` opens.
"""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import math
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from tidegauge.sources.payloads import SENTINELS

LONG_DDL = "series_id string, data date, value double"
SURVEY_DDL = "series_id string, survey_date date, ref_date date, indicator string, calc string, mean double, median double"
TYPES = {"string": pa.string(), "date": pa.date32(), "double": pa.float64()}
WINDOW = re.compile(r"window=(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})$")
BATCH_ROWS = 10_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
TOKEN = re.compile(r"\S")
NUMBER = re.compile(r"\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")


def _lenient(text) -> float | None:
    """A number, or None for any other text."""
    return float(text) if text is not None and NUMBER.match(str(text)) else None


def _strict(text, missing: tuple[str, ...] = ()) -> float | None:
    """A number; nothing for empty and listed texts; anything else is an error."""
    if text is None or not str(text).strip() or str(text).strip() in missing:
        return None
    value = _lenient(text)
    if value is None:
        raise ValueError(f"not a number: {text!r}")
    return value


def _comma(text: str | None) -> float | None:
    value = _strict(text and text.replace(",", "."), ("NaN", "nan"))
    return None if value is None or math.isnan(value) else value


def _day(text: str, pattern: str) -> dt.date:
    return dt.datetime.strptime(text, pattern).date()


def _documents(text: str):
    """The JSON documents of a file: one, or several after each other."""
    decoder, at = json.JSONDecoder(), 0
    while found := TOKEN.search(text, at):
        document, at = decoder.raw_decode(text, found.start())
        yield document


def _json_array(text: str, _):
    for record in (r for d in _documents(text) for r in d):
        yield _day(record["data"], "%d/%m/%Y"), _lenient(record["valor"])


def _json_sentinel(text: str, _):
    for record in (r for d in _documents(text) for r in d):
        if record["V"] not in SENTINELS:
            yield _day(record["D3C"], "%Y%m"), _strict(record["V"])


def _json_nested(text: str, _):
    for record in (r for d in _documents(text) for r in d["value"]):
        stamp = dt.datetime.fromisoformat(record["VALDATA"])
        yield stamp.astimezone(dt.timezone.utc).date(), _strict(record["VALVALOR"])


def _csv_wide(text: str, _):
    table = csv.reader(io.StringIO(text))
    next(table, None)
    for day, reading in table:
        yield dt.date.fromisoformat(day), _strict(reading, (".",))


def _period(text: str, ref: str) -> dt.date:
    if ref == "quarter":
        quarter, year = text.split("/")
        return dt.date(int(year), 3 * int(quarter) - 2, 1)
    return _day(text, {"month": "%m/%Y", "year": "%Y"}[ref])


def _survey(text: str, ref: str | None):
    for row in csv.DictReader(io.StringIO(text)):
        period = _period(row["DataReferencia"], ref) if ref else None
        kind = row.get("Indicador"), row.get("tipoCalculo")
        yield dt.date.fromisoformat(row["Data"]), period, *kind, _comma(row["Media"]), _comma(row.get("Mediana"))


LAYOUTS = {
    "json_array": _json_array,
    "json_sentinel": _json_sentinel,
    "json_nested": _json_nested,
    "csv_wide": _csv_wide,
    "survey": _survey,
}


@dataclass
class PayloadFile(InputPartition):
    """A file to read, its series and the days its folder promises."""

    path: str
    series_id: str
    first: dt.date | None = None
    last: dt.date | None = None


class PayloadSource(DataSource):
    """See the module's text. Options: ``path``, ``layout``, and ``ref`` for surveys."""

    @classmethod
    def name(cls) -> str:
        return "payload"

    def _layout(self) -> str:
        layout = self.options.get("layout", "")
        if layout not in LAYOUTS:
            raise ValueError(f"layout {layout!r} is none of {', '.join(LAYOUTS)}")
        return layout

    def schema(self) -> str:
        return SURVEY_DDL if self._layout() == "survey" else LONG_DDL

    def reader(self, schema) -> PayloadReader:
        ref = self.options.get("ref", "month")
        return PayloadReader(self.options["path"], self._layout(), None if ref == "none" else ref)


class PayloadReader(DataSourceReader):
    def __init__(self, path: str, layout: str, ref: str | None):
        self.path, self.layout, self.ref = path, layout, ref
        self.day = "survey_date" if layout == "survey" else "data"
        self.series: set[str] | None = None
        self.first, self.last = dt.date.min, dt.date.max

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take note of what folders' names can answer; Spark still filters the rows."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column == "series_id" and isinstance(f, (EqualTo, In)):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.series = asked if self.series is None else self.series & asked
            elif column == self.day:
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value)
            yield f

    def partitions(self) -> list[PayloadFile]:
        """The files whose folders may hold rows that are asked for; none is opened."""
        store, root = _store(self.path)
        found = []
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            folders, name = posixpath.split(info.path[len(root) :].strip("/"))
            if info.type != fs.FileType.File or name.startswith(("_", ".")):
                continue
            held = dict(p.split("=", 1) for p in folders.split("/") if "=" in p)
            if "series_id" not in held:
                raise ValueError(f"{info.path} is in no folder of a series")
            file = PayloadFile(info.path, unquote(held["series_id"]))
            window = WINDOW.search(folders)
            if window:
                file.first, file.last = map(dt.date.fromisoformat, window.groups())
            if self._wanted(file):
                found.append(file)
        return sorted(found, key=lambda f: f.path)

    def _wanted(self, file: PayloadFile) -> bool:
        if self.series is not None and file.series_id not in self.series:
            return False
        return file.first is None or (file.first <= self.last and self.first <= file.last)

    def read(self, partition: PayloadFile | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes when no file is wanted
            return
        store, _ = _store(self.path)  # a file's path is one of this store
        with store.open_input_stream(partition.path) as stream:
            text = stream.read().decode("utf-8")
        try:
            rows = [(partition.series_id, *row) for row in LAYOUTS[self.layout](text, self.ref)]
        except (ValueError, KeyError, TypeError) as error:
            raise ValueError(f"cannot parse {partition.path}: {error}") from error
        for row in rows:
            if partition.first and not partition.first <= row[1] <= partition.last:
                raise ValueError(f"{partition.path} holds {row[1]}, outside of its window")
        ddl = SURVEY_DDL if self.layout == "survey" else LONG_DDL
        fields = [pa.field(n, TYPES[t]) for n, t in map(str.split, ddl.split(", "))]
        for at in range(0, len(rows), BATCH_ROWS):
            columns = zip(*rows[at : at + BATCH_ROWS])
            arrays = [pa.array(c, f.type) for c, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays(arrays, schema=pa.schema(fields))


def _store(path: str) -> tuple[fs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)
    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return store, root.rstrip("/")


def register(spark: SparkSession) -> None:
    """Make ``format("payload")`` known to the session and let it see filters."""
    spark.dataSource.register(PayloadSource)
    spark.conf.set(PUSHDOWN, "true")
