"""Tables from files: csv, tsv, json, ndjson, xlsx, and what Spark reads itself."""

from __future__ import annotations

import datetime as dt
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain
from pathlib import PurePosixPath
from xml.parsers import expat

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tallyline.functions import headers
from tallyline.sources import shared


def read_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """All text; empty cells are null, blank rows are skipped, short rows are padded, extra cells dropped."""
    options = {"header": True, "sep": sep, "multiLine": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8", "nullValue": "", "emptyValue": "", "enforceSchema": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df = spark.read.options(**options).csv(path)
    df = df.toDF(*headers.normalise_all([c.lstrip("﻿") for c in df.columns]))
    return df.filter(F.coalesce(*[F.when(F.trim(F.col(f"`{c}`")) != "", True) for c in df.columns], F.lit(False)))


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, "\t")


def _objects(df: DataFrame, path: str) -> DataFrame:
    if "_corrupt_record" in df.columns:
        raise ValueError(f"{path} doesn't hold JSON objects alone")
    return headers.merge(df)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects; kinds that differ by cell become text."""
    text = spark.read.text(path, wholetext=True)
    if text.filter(~F.trim("value").startswith("[")).limit(1).count():
        raise ValueError(f"{path} doesn't hold an array of objects")
    return _objects(spark.read.option("multiLine", True).option("prefersDecimal", True).json(path), path)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    """An object a line, blank lines skipped; an error names the first bad line's text."""
    try:
        return headers.merge(spark.read.option("mode", "FAILFAST").option("prefersDecimal", True).json(path))
    except Exception as e:
        bad = spark.read.text(path).filter(F.trim("value") != "").filter(F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")).limit(1).collect()
        raise ValueError(f"{path}: not a JSON object: {bad[0][0][:80] if bad else e}") from None


#: Names inside a workbook, and the built-in number formats that show dates. Fixed values.
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 27, 28, 29, 30, 31, 32, 33, 34, 35, 36, 45, 46, 47, 50, 51, 52, 53, 54, 55, 56, 57, 58}


def _xml(book: zipfile.ZipFile, name: str) -> ET.Element | None:
    if name not in book.namelist():
        return None
    data = book.read(name)
    if b"<!DOCTYPE" in data[:2000] or b"<!ENTITY" in data:
        raise ValueError("document types are not allowed in a workbook")
    return ET.fromstring(data)


@dataclass(frozen=True)
class Workbook:
    """What a sheet's cells refer to: the file's shared texts, which styles show dates, and the day 0."""

    part: str
    strings: list[str]
    dated: list[bool]
    epoch: dt.datetime

    def row(self, row: ET.Element) -> list[object]:
        """Cached values of a row's cells, at their columns; dates by the cells' number formats."""
        out: list[object] = []
        for cell in row.iter(f"{_MAIN}c"):
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1 if letters else len(out)
            out += [None] * (at + 1 - len(out))
            value, kind = cell.find(f"{_MAIN}v"), cell.get("t", "n")
            if kind == "inlineStr":
                out[at] = "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
            elif value is None or value.text is None:
                continue
            elif kind == "s":
                out[at] = self.strings[int(value.text)]
            elif kind == "b":
                out[at] = value.text == "1"
            elif kind == "n":
                style = int(cell.get("s", 0))
                number = float(value.text)
                if style < len(self.dated) and self.dated[style]:
                    out[at] = self.epoch + dt.timedelta(microseconds=round(number * 86_400_000_000 / 1000) * 1000)
                else:
                    out[at] = int(number) if number.is_integer() and "e" not in value.text.lower() else number
            else:
                out[at] = value.text
        return out


def _workbook(book: zipfile.ZipFile, sheet: str | None) -> Workbook:
    shared_texts = _xml(book, "xl/sharedStrings.xml")
    strings = ["".join(t.text or "" for t in si.iter(f"{_MAIN}t")) for si in shared_texts] if shared_texts is not None else []
    styles, dated, customs = _xml(book, "xl/styles.xml"), [], {}
    if styles is not None:
        customs = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(f"{_MAIN}numFmt")}
        shows = lambda k: k in _DATE_FORMATS or bool(re.search(r"[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", customs.get(k, "")).lower()))
        formats = styles.find(f"{_MAIN}cellXfs")
        dated = [shows(int(x.get("numFmtId", 0))) for x in (formats if formats is not None else ())]
    main = _xml(book, "xl/workbook.xml")
    targets = {r.get("Id"): r.get("Target") for r in _xml(book, "xl/_rels/workbook.xml.rels")}
    epoch = dt.datetime(1904, 1, 1) if (pr := main.find(f"{_MAIN}workbookPr")) is not None and pr.get("date1904") in ("1", "true") else dt.datetime(1899, 12, 30)
    sheets = {s.get("name"): targets[s.get(f"{_REL}id")] for s in main.iter(f"{_MAIN}sheet")}
    if sheet is not None and sheet not in sheets:
        raise ValueError(f"no sheet named {sheet!r}; there are {', '.join(sheets)}")
    target = sheets[sheet if sheet is not None else next(iter(sheets))]
    return Workbook(target.lstrip("/") if target.startswith("/") else str(PurePosixPath("xl") / target), strings, dated, epoch)


@lru_cache(maxsize=1)
def _known(version: tuple[str, int, int], sheet: str | None) -> Workbook:
    """A worker reads the shared texts of a file's state once, for all ranges that it is given."""
    with shared.opened(version[0]) as f, zipfile.ZipFile(f) as book:
        return _workbook(book, sheet)


def _refuse(*_) -> None:
    raise ValueError("document types are not allowed in a workbook")


def _checked(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The pieces, which raise ValueError if a document type stands before the root."""
    parser, begun = expat.ParserCreate(), []
    parser.StartDoctypeDeclHandler, parser.StartElementHandler = _refuse, lambda *_: begun.append(True)
    for piece in pieces:
        if not begun:
            parser.Parse(piece)
        yield piece


def _rows(pieces: Iterable[bytes]) -> Iterator[ET.Element]:
    """The row elements of a sheet's XML as they end; none is kept."""
    parser, above = ET.XMLPullParser(("start", "end")), []
    for piece in _checked(pieces):
        parser.feed(piece)
        for event, element in parser.read_events():
            if event == "start":
                above.append(element)
                continue
            above.pop()
            if element.tag == f"{_MAIN}row":
                yield element
                above[-1].clear()


class RowRange(InputPartition):
    """Rows whose XML lies in bytes low to high of the sheet; what stands before byte ``head`` opens the document."""

    def __init__(self, head: int, low: int, high: int):
        self.head, self.low, self.high = head, low, high


def _ranges(pieces: Iterable[bytes], rows_each: int) -> list[RowRange]:
    """Ranges of ``rows_each`` rows, by the offsets at which a parser meets them; the first range has the header row too."""
    parser, starts, seen, stop = expat.ParserCreate(namespace_separator="}"), [], 0, 0

    def begin(name: str, _) -> None:
        nonlocal seen
        if "{" + name == f"{_MAIN}row":
            if seen == 0 or seen > 1 and (seen - 1) % rows_each == 0:
                starts.append(parser.CurrentByteIndex)
            seen += 1

    def end(name: str) -> None:
        nonlocal stop
        if "{" + name == f"{_MAIN}sheetData":
            stop = parser.CurrentByteIndex

    parser.StartElementHandler, parser.EndElementHandler, parser.StartDoctypeDeclHandler = begin, end, _refuse
    for piece in pieces:
        parser.Parse(piece)
    parser.Parse(b"", True)
    return [RowRange(starts[0], a, b) for a, b in zip(starts, [*starts[1:], stop], strict=True)]


def _pieces(f, low: int, high: int | None = None, size: int = 1 << 20) -> Iterator[bytes]:
    """Bytes low to high of an open part, or to its end; what comes before is inflated, not parsed."""
    f.seek(low)
    while (high is None or low < high) and (piece := f.read(size if high is None else min(size, high - low))):
        low += len(piece)
        yield piece


def _kind(kinds: set[type]) -> T.DataType:
    if kinds == {bool}:
        return T.BooleanType()
    if kinds and kinds <= {int, float}:
        return T.DoubleType() if float in kinds else T.LongType()
    return T.TimestampNTZType() if kinds == {dt.datetime} else T.StringType()


def _cell_text(value: object) -> str | None:
    if isinstance(value, dt.datetime):
        return value.strftime("%Y-%m-%d") if value.time() == dt.time() else value.strftime("%Y-%m-%dT%H:%M:%SZ")
    return None if value is None else str(value).lower() if isinstance(value, bool) else repr(value) if isinstance(value, float) else str(value)


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, rows_each: int, schema: T.StructType):
        self.path, self.sheet, self.rows_each, self.schema = path, sheet, rows_each, schema

    def partitions(self) -> list[RowRange]:
        known = _known(shared.version(self.path), self.sheet)
        with shared.opened(self.path) as f, zipfile.ZipFile(f) as book, book.open(known.part) as part:
            return _ranges(_pieces(part, 0), self.rows_each) or [RowRange(0, 0, 0)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        known = _known(shared.version(self.path), self.sheet)
        width = len(self.schema)
        casts = [(lambda v: None if v is None else float(v)) if isinstance(f.dataType, T.DoubleType) else _cell_text if isinstance(f.dataType, T.StringType) else (lambda v: v) for f in self.schema]
        with shared.opened(self.path) as f, zipfile.ZipFile(f) as book, book.open(known.part) as part:
            rows = map(known.row, _rows(chain(_pieces(part, 0, partition.head), _pieces(part, partition.low, partition.high))))
            if partition.low == partition.head:
                next(rows, None)  # the header
            for row in rows:
                if any(v is not None for v in row):
                    yield tuple(cast(v) for cast, v in zip(casts, (row + [None] * width)[:width], strict=True))


class WorkbookSource(DataSource):
    """Format ``tallyline_xlsx``: options path, sheet, rows_per_partition. Columns of one kind keep it, mixed ones become canonical text.

    Partitions are ranges of the sheet's rows. The driver passes over the sheet for the kinds and for the ranges and keeps
    no rows; a task inflates up to its range and parses that alone. The path must be one that executors reach.
    """

    @classmethod
    def name(cls) -> str:
        return "tallyline_xlsx"

    def schema(self) -> T.StructType:
        path, sheet = self.options["path"], self.options.get("sheet")
        known = _known(shared.version(path), sheet)
        with shared.opened(path) as f, zipfile.ZipFile(f) as book, book.open(known.part) as part:
            rows = map(known.row, _rows(_pieces(part, 0)))
            names = headers.normalise_all(next(rows, []))
            kinds: list[set[type]] = [set() for _ in names]
            for row in rows:
                for held, value in zip(kinds, row, strict=False):
                    if value is not None:
                        held.add(type(value))
        return T.StructType([T.StructField(n, _kind(k)) for n, k in zip(names, kinds, strict=True)])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), int(self.options.get("rows_per_partition", "50000")), schema)


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, rows_per_partition: int = 50_000) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    return spark.read.format("tallyline_xlsx").options(path=path, rows_per_partition=rows_per_partition, **({"sheet": sheet} if sheet else {})).load()


READERS = {".csv": read_csv, ".tsv": read_tsv, ".json": read_json, ".ndjson": read_ndjson, ".jsonl": read_ndjson, ".xlsx": read_xlsx, ".xlsm": read_xlsx}


def load(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """The table in a file, by its extension; parquet and orc are read by Spark."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix in (".xlsx", ".xlsm"):
        return read_xlsx(spark, path, sheet)
    if suffix in (".parquet", ".orc"):
        return spark.read.format(suffix[1:]).load(path)
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or 'files without an extension'}; there are {', '.join(READERS)}")
    return READERS[suffix](spark, path)


def frame(spark: SparkSession, data: object) -> DataFrame:
    """A DataFrame as it is, pandas frames and lists of dicts converted; anything else raises TypeError."""
    if isinstance(data, DataFrame):
        return data
    if type(data).__module__.startswith("pandas"):
        return spark.createDataFrame(data.reset_index(drop=True).convert_dtypes())
    if isinstance(data, list) and all(isinstance(r, dict) for r in data):
        names = list(dict.fromkeys(k for r in data for k in r))
        kinds = {n: {type(r[n]) for r in data if r.get(n) is not None} for n in names}
        text = {n for n, k in kinds.items() if len(k) != 1 or not k <= {bool, int, float, str, dt.date, dt.datetime}}
        rows = [tuple(_cell_text(r.get(n)) if n in text else r.get(n) for n in names) for r in data]
        simple = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType(), dt.date: T.DateType(), dt.datetime: T.TimestampType()}
        return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.StringType() if n in text else simple[next(iter(kinds[n]))]) for n in names]))
    raise TypeError(f"expected a DataFrame, a pandas frame or a list of dicts, not {type(data).__name__}")
