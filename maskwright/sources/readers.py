"""Reading texts, cases, mappings and office files into DataFrames."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Office files beyond this are listed with an error instead of being read into one row.
MAX_FILE_BYTES = 256 << 20
CASE_ITEM = "array<struct<type:string,value:string>>"
CELL_BREAK = "␊"
#: File kinds that a batch takes.
KINDS = ("txt", "md", "docx", "xlsx", "csv", "json", "html", "htm", "pdf", "png", "jpg", "jpeg")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below a folder that are neither hidden nor this engine's own output."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return found.where(~name.rlike(r"^[.~]|_脱敏|_mapping") & kind.isin(*KINDS))


def cases(spark: SparkSession, path: str) -> DataFrame:
    """Labelled cases, a JSON object a line; blank, commented and broken lines are skipped."""
    schema = f"id string, note string, text string, expect_masked {CASE_ITEM}, expect_kept {CASE_ITEM}, expect_absent array<string>, llm_only {CASE_ITEM}"
    lines = spark.read.text(path).where(r"NOT value RLIKE '^\\s*(#|$)'")
    rows = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("c")).where("c.text IS NOT NULL").select("c.*")
    none = {c: F.array().cast(t) for c, t in rows.dtypes if t.startswith("array")}
    return rows.select(*(F.coalesce(c, none[c]).alias(c) if c in none else c for c in rows.columns))


def mapping_from_markdown(text: Column) -> Column:
    """array<struct<ord, original, replacement, type, count>> of a Markdown table; cells keep their blanks inside."""
    rows = F.filter(F.split(text, "\n"), lambda r: r.rlike(r"^\|\s*[0-9]+\s*\|"))

    def one(r: Column) -> Column:
        c = F.split(r, r"\|", -1)
        cell = lambda i: F.regexp_replace(F.get(c, i), "^ | $", "")
        return F.struct(F.trim(F.get(c, 1)).cast("int").alias("ord"), cell(2).alias("original"), cell(3).alias("replacement"), F.trim(F.get(c, 4)).alias("type"), F.trim(F.get(c, 5)).cast("int").alias("count"))

    return F.transform(rows, one)


def mapping_to_markdown(mapping: Column) -> Column:
    head = "| 序号 | 原始值 | 替换值 | 类型 | 出现次数 | 验证 |\n| --- | --- | --- | --- | --- | --- |"
    row = lambda m: F.concat(F.lit("| "), F.concat_ws(" | ", m["ord"].cast("string"), m["original"], m["replacement"], m["type"], m["count"].cast("string"), F.when(m["validated"], "✓").otherwise("—")), F.lit(" |"))
    return F.array_join(F.concat(F.array(F.lit(head)), F.transform(counted_mapping(mapping), row)), "\n")


MAPPING_JSON = "struct<mapping:array<struct<original:string,replacement:string,type:string,count:int,order:int,validated:boolean>>>"


def mapping_from_json(text: Column) -> Column:
    """array<struct<ord, original, replacement, type, count>> of a JSON mapping; null where it is none."""
    rows = F.from_json(text, MAPPING_JSON)["mapping"]
    return F.transform(rows, lambda m: F.struct(F.coalesce(m["order"], F.lit(0)).alias("ord"), m["original"], m["replacement"], F.coalesce(m["type"], F.lit("")).alias("type"), F.coalesce(m["count"], F.lit(1)).alias("count")))


def counted_mapping(mapping: Column) -> Column:
    """A mapping with a row for each different value and ``count``, how often it was replaced, by first appearance."""
    same = lambda a, b: (a["original"] == b["original"]) & (a["replacement"] == b["replacement"]) & (a["type"] == b["type"])
    keys = F.array_distinct(F.transform(mapping, lambda m: F.struct(m["original"], m["replacement"], m["type"], m["validated"])))
    return F.transform(keys, lambda k, i: F.struct((i + 1).cast("int").alias("ord"), k["original"], k["replacement"], k["type"], k["validated"], F.size(F.filter(mapping, lambda m: same(m, k))).alias("count")))


def mapping_to_json(mapping: Column) -> Column:
    rows = F.transform(counted_mapping(mapping), lambda m: F.struct(m["original"], m["replacement"], m["type"], m["count"], m["ord"].alias("order"), m["validated"]))
    return F.to_json(F.struct(rows.alias("mapping")))


def _docx(content: bytes) -> str:
    ns = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{ns}t")) for p in body.iter(f"{ns}p"))


def cell_place(reference: str) -> tuple[int, int]:
    """Row and column, from 1, of a cell's reference."""
    letters, row = re.fullmatch(r"([A-Z]+)(\d+)", reference).groups()
    column = 0
    for ch in letters:
        column = column * 26 + ord(ch) - 64
    return int(row), column


def sheet_parts(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """Names of a workbook's sheets and the parts that hold them, found by their relations; by their order where there are none."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    sheets = [*book.iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}sheet")]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            targets[r.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    by = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    return [(s.get("name"), targets.get(s.get(by), f"xl/worksheets/sheet{k}.xml")) for k, s in enumerate(sheets, 1)]


def _xlsx(content: bytes) -> list[tuple[str, int, int, str]]:
    """sheet, row, column and text of string and number cells; formulas and booleans take no part."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    z = zipfile.ZipFile(io.BytesIO(content))
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{ns}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
    out = []
    for name, part in sheet_parts(z):
        for c in ElementTree.fromstring(z.read(part)).iter(f"{ns}c"):
            value = c.find(f"{ns}v")
            inline = "".join(t.text or "" for t in c.iter(f"{ns}t"))
            if c.find(f"{ns}f") is not None or c.get("t") == "b" or (value is None and not inline):
                continue
            raw = inline or (shared[int(value.text)] if c.get("t") == "s" else value.text or "")
            if c.get("t") in (None, "n") and re.fullmatch(r"-?\d+\.0+", raw):
                raw = raw.split(".")[0]
            out.append((name, *cell_place(c.get("r")), raw.replace("\n", CELL_BREAK)))
    return out


def _read(found: DataFrame, run, schema: str) -> DataFrame:
    """Rows of ``run`` for the files that fit one row, and a row with an error for each that doesn't, whose content is not read."""
    large = found.where(F.col("length") >= MAX_FILE_BYTES).select("path", F.format_string(f"%d bytes, the limit is {MAX_FILE_BYTES}", "length").alias("error"))
    fits = found.where(F.col("length") < MAX_FILE_BYTES).select("path", "content").mapInPandas(run, schema)
    return fits.unionByName(large, allowMissingColumns=True)


def docx_texts(found: DataFrame) -> DataFrame:
    """path, text and error of Word files among ``files``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows.append((path, _docx(content), None))
                except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:  # a broken file is a row, not a failed job
                    rows.append((path, None, repr(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "error"])

    return _read(found, run, "path string, text string, error string")


def xlsx_cells(found: DataFrame) -> DataFrame:
    """path, sheet, row_idx, col_idx, value and error of spreadsheets among ``files``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, *cell, None) for cell in _xlsx(content)]
                except (KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows.append((path, None, None, None, None, repr(e)))
            yield pd.DataFrame(rows, columns=["path", "sheet", "row_idx", "col_idx", "value", "error"])

    return _read(found, run, "path string, sheet string, row_idx int, col_idx int, value string, error string")


#: A reader of pages: the bytes of a file to (page, text, x, y, w, h) of its boxes, in shares of the page's size.
PageReader = Callable[[bytes], list[tuple[int, str, float, float, float, float]]]


def pdf_page_reader() -> PageReader:
    """Words of a PDF's text layer with their boxes; the library is needed where it runs only."""
    import pdfplumber

    def read(content: bytes) -> list[tuple[int, str, float, float, float, float]]:
        with pdfplumber.open(io.BytesIO(content)) as pdf:
            return [
                (k, w["text"], w["x0"] / p.width, 1 - w["bottom"] / p.height, (w["x1"] - w["x0"]) / p.width, (w["bottom"] - w["top"]) / p.height)
                for k, p in enumerate(pdf.pages, 1) for w in p.extract_words()
            ]

    return read


def page_boxes(found: DataFrame, factory: Callable[[], PageReader]) -> DataFrame:
    """path, page, text, x, y, w, h and error of files among ``files``: PDF, images or scans, by a reader made once per worker.

    A file that can't be read is a row with an error. ``boxes.text_lines`` makes lines of the boxes.
    """
    names = ["path", "page", "text", "x", "y", "w", "h", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = factory()
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(path, *box, None) for box in read(bytes(content))]
                except Exception as e:  # noqa: BLE001  readers are plug-ins; whatever they raise is the file's error
                    rows.append((path, *(None,) * 6, repr(e)))
            yield pd.DataFrame(rows, columns=names)

    return _read(found, run, "path string, page int, text string, x double, y double, w double, h double, error string")
