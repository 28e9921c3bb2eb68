"""Readers by file extension, and the sinks. Every reader returns a lazy DataFrame."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Raw cells that are read as missing.
NA_TOKENS = ("", "NA", "N/A", "n/a", "null", "NULL", "None", "NaN")
MORE_NA_TOKENS = ("#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "nan")
SPACED_COMMA = r"\s+,(?=\s|$)"
SNIFF_LINES = 20

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(extension: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    REGISTRY[extension.lower()] = reader


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table of a file or folder, by its extension."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in REGISTRY:
        raise ValueError(f"no reader for {extension!r}; registered: {sorted(REGISTRY)}")
    return REGISTRY[extension](spark, path)


def _missing(df: DataFrame) -> DataFrame:
    text = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    tokens = [*NA_TOKENS, *MORE_NA_TOKENS]
    return df.select(*(F.when(~F.col(f"`{c}`").isin(*tokens), F.col(f"`{c}`")).alias(c) if c in text else F.col(f"`{c}`") for c in df.columns))


def _typed(df: DataFrame) -> DataFrame:
    """Text columns whose filled cells are all whole numbers, numbers or truth values get that type, by one job."""
    whole, number, truth = r"^[+-]?\d{1,18}$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", r"^(True|False|TRUE|FALSE|true|false)$"
    tests = [F.struct(F.count(c), *(F.count_if(c.rlike(p)) for p in (whole, number, truth))).alias(f"c{k}") for k, c in enumerate(F.col(f"`{x}`") for x in df.columns)]
    row = df.agg(*tests).head() if tests else ()
    cast = {}
    for c, (n, ints, doubles, truths) in zip(df.columns, row, strict=True):
        kind = "long" if n and ints == n else "double" if n and doubles == n else "boolean" if n and truths == n else None
        if kind:
            cast[c] = kind
    return df.select(*(F.col(f"`{c}`").try_cast(cast[c]).alias(c) if c in cast else F.col(f"`{c}`") for c in df.columns))


def read_csv(spark: SparkSession, path: str, typed: bool = True) -> DataFrame:
    """Delimited text with a header; the separator is found from the first lines.

    Where the header has blanks around its commas, only such commas separate, so that
    unquoted amounts keep theirs.
    """
    first = [r["value"] for r in spark.read.text(path).limit(SNIFF_LINES).collect()]
    if not first:
        raise ValueError(f"{path} is empty")
    if re.search(r"\s,\s", first[0]) and not re.search(r"\S,\S", first[0]):
        names = [x.strip() for x in re.split(SPACED_COMMA, first[0])]
        parts = F.transform(F.split("value", SPACED_COMMA), lambda x: F.trim(x))
        lines = spark.read.text(path).where((F.col("value") != first[0]) & (F.trim("value") != "")).select(parts.alias("p"))
        df = lines.select(*(F.try_element_at("p", F.lit(k + 1)).alias(n) for k, n in enumerate(names)))
    else:
        try:
            separator = csv.Sniffer().sniff("\n".join(first), delimiters=",;\t|").delimiter
        except csv.Error:
            separator = ","
        df = spark.read.option("header", True).option("sep", separator).option("ignoreLeadingWhiteSpace", True).option("multiLine", False).csv(path)
    df = _missing(df)
    return _typed(df) if typed else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, a record a line, or one object in the split or the column orientation."""
    df = spark.read.option("multiLine", True).json(path)
    whole = [r["value"] for r in spark.read.text(path, wholetext=True).limit(2).collect()] if _one_object(df) else []
    if len(whole) == 1:
        try:
            data = json.loads(whole[0])
        except ValueError:
            data = None  # a record a line
        if isinstance(data, dict):
            return _oriented(spark, data)
        if data is None:
            return spark.read.json(path)
    return df


def _one_object(df: DataFrame) -> bool:
    return len(df.limit(2).take(2)) == 1


def _oriented(spark: SparkSession, data: dict) -> DataFrame:
    if {"columns", "data"} <= set(data):
        names, rows = data["columns"], data["data"]
    elif data and all(isinstance(v, dict) for v in data.values()):
        keys = list(dict.fromkeys(k for v in data.values() for k in v))
        names, rows = list(data), [[v.get(k) for v in data.values()] for k in keys]
    elif data and all(isinstance(v, list) for v in data.values()):
        names, rows = list(data), [list(r) for r in zip(*data.values(), strict=True)]
    else:
        names, rows = list(data), [list(data.values())]
    lines = [json.dumps(dict(zip(names, row, strict=True))) for row in rows]
    schema = T.StructType([T.StructField("value", T.StringType())])
    found = spark.createDataFrame([(x,) for x in lines], schema)
    inferred = spark.read.json(spark.sparkContext.parallelize(lines, 1)).schema if lines else T.StructType([])
    ordered = T.StructType([inferred[n] for n in names if n in inferred.fieldNames()])
    return found.select(F.from_json("value", ordered).alias("v")).select("v.*")


class _Tables(HTMLParser):
    """Cells of the first table that has any; nested tables are text of their cell."""

    def __init__(self):
        super().__init__()
        self.rows: list[list[str]] = []
        self.depth, self.done, self.cell, self.header = 0, False, None, False

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth == 1 and tag == "tr":
            self._end()
            self.rows.append([])
        elif self.depth == 1 and tag in ("td", "th"):
            self._end()
            self.cell = []
            self.header |= tag == "th" and len(self.rows) == 1

    def handle_endtag(self, tag):
        if self.done:
            return
        if tag in ("td", "th", "tr") and self.depth == 1:
            self._end()
        elif tag == "table" and self.depth:
            self._end()
            self.depth -= 1
            self.done = not self.depth and any(self.rows)

    def handle_data(self, data):
        if self.cell is not None and not self.done:
            self.cell.append(data)

    def _end(self):
        if self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None


def first_table(html: str) -> list[list[str]]:
    """Rows of the first table, the header first."""
    p = _Tables()
    p.feed(html)
    rows = [r for r in p.rows if r]
    if not rows:
        raise ValueError("no tables found")
    return rows if p.header else [[str(k) for k in range(max(map(len, rows)))], *rows]


def first_sheet(data: bytes) -> list[list[str | None]]:
    """Rows of the first sheet of an .xlsx workbook."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si"):
                shared.append("".join(t.text or "" for t in item.iter(f"{ns}t")))
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        if not sheets:
            raise ValueError("the workbook has no sheet")
        rows = []
        for row in ElementTree.fromstring(z.read(sheets[0])).iter(f"{ns}row"):
            cells: dict[int, str | None] = {}
            for k, c in enumerate(row.iter(f"{ns}c")):
                letters = re.match(r"[A-Z]+", c.get("r", ""))
                at = k if not letters else sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters[0]))) - 1
                value, kind = c.find(f"{ns}v"), c.get("t")
                if kind == "inlineStr":
                    cells[at] = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                elif value is not None:
                    cells[at] = shared[int(value.text)] if kind == "s" else ("True" if value.text == "1" else "False") if kind == "b" else value.text
            rows.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
        return rows


def _small_file(spark: SparkSession, path: str, parse: Callable[[bytes], list[list]]) -> DataFrame:
    """A table parsed from one file, which has to be read whole."""
    files = spark.read.format("binaryFile").load(path).select("content").limit(2).collect()
    if len(files) != 1:
        raise ValueError(f"{path} isn't one file")
    header, *rows = parse(bytes(files[0]["content"])) or [[]]
    names = [str(h) if h is not None else f"_{k}" for k, h in enumerate(header)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    cells = [tuple((row[k] if k < len(row) else None) for k in range(len(names))) for row in rows]
    return _typed(_missing(spark.createDataFrame(cells, schema)))


def read_html(spark: SparkSession, path: str) -> DataFrame:
    return _small_file(spark, path, lambda data: first_table(data.decode("utf-8", "replace")))


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".xls"):
        raise ValueError("the binary .xls format isn't supported; save the workbook as .xlsx")
    return _small_file(spark, path, first_sheet)


for _extension, _reader in {
    ".csv": read_csv, ".parquet": read_parquet, ".json": read_json, ".xlsx": read_excel, ".xls": read_excel, ".html": read_html, ".htm": read_html,
}.items():
    register(_extension, _reader)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header: a folder of parts, or with ``single`` one file, for results that one task can write."""
    if not single:
        df.write.mode("overwrite").option("header", True).csv(path)
        return
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(parts := f"{path}.parts")
    to, fs = _file_system(df.sparkSession, path)
    found = fs.globStatus(_file_system(df.sparkSession, f"{parts}/part-*")[0])
    fs.delete(to, True)
    fs.rename(found[0].getPath(), to)
    fs.delete(_file_system(df.sparkSession, parts)[0], True)


def _file_system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, wherever Spark can write."""
    to, fs = _file_system(spark, path)
    out = fs.create(to, True)
    out.write(bytearray(data))
    out.close()


def workbook(rows: list[tuple]) -> bytes:
    """A workbook of one sheet, for small tables: numbers as numbers, all else as text in place."""
    def cell(v: object) -> str:
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v}</v></c>"
        return "<c/>" if v is None else f'<c t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = "".join(f"<row>{''.join(map(cell, row))}</row>" for row in rows)
    with zipfile.ZipFile(data := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return data.getvalue()


def preview(df: DataFrame, n: int = 5) -> Iterator[str]:
    """Lines of the first rows, for a console."""
    yield " | ".join(df.columns)
    for row in df.limit(n).collect():
        yield " | ".join(str(v) for v in row)
