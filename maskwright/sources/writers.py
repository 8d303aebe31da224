"""Writing masked texts back: text, Word and spreadsheet files as binary columns, and driver-side stores."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .readers import CELL_BREAK, cell_place, sheet_parts

_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_X = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
#: Parts of an office file that hold texts of their own and properties; they are cleared.
_CLEARED = ("docProps/core.xml", "docProps/app.xml", "docProps/custom.xml", "word/comments.xml")


def texts(masked: DataFrame, path: str, text_col: str = "masked") -> None:
    """One line of a text file for each text; line breaks inside are kept as spaces of their own mark."""
    masked.select(F.replace(text_col, F.lit("\n"), F.lit("␊")).alias("value")).write.mode("overwrite").text(path)


def _refilled_docx(content: bytes, text: str) -> bytes:
    """The file with its paragraphs' texts replaced in reading order, headers and properties cleared."""
    ElementTree.register_namespace("w", _W)
    source, out, lines = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO(), iter(text.split("\n"))
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in source.namelist():
            data = source.read(name)
            if name == "word/document.xml":
                root = ElementTree.fromstring(data)
                for p in root.iter(f"{{{_W}}}p"):
                    runs, line = [*p.iter(f"{{{_W}}}t")], next(lines, "")
                    for i, t in enumerate(runs):
                        t.text = line if i == 0 else ""
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            elif name in _CLEARED:
                continue
            elif name.startswith(("word/header", "word/footer")):
                root = ElementTree.fromstring(data)
                for t in root.iter(f"{{{_W}}}t"):
                    t.text = ""
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            z.writestr(name, data)
    return out.getvalue()


def refill_docx(files: DataFrame) -> DataFrame:
    """path and content of Word files, given path, content and the masked text of each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [_refilled_docx(c, t) for c, t in zip(b["content"], b["masked"], strict=True)]})

    return files.select("path", "content", "masked").mapInPandas(run, "path string, content binary")


def _sheet(rows: list[tuple[int, int, str]]) -> bytes:
    """A spreadsheet of inline strings in one sheet."""
    def letters(c: int) -> str:
        out = ""
        while c:
            c, r = divmod(c - 1, 26)
            out = chr(65 + r) + out
        return out

    body, at = [], {}
    for r, c, v in sorted(rows):
        at.setdefault(r, []).append(f'<c r="{letters(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>')
    body = "".join(f'<row r="{r}">{"".join(cs)}</row>' for r, cs in at.items())
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kinds}.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{pack}/relationships"><Relationship Id="r1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def xlsx(cells: DataFrame, value_col: str = "masked") -> DataFrame:
    """path and content of a spreadsheet for each path's cells; a spreadsheet is one file and one row."""
    rows = cells.groupBy("path").agg(F.collect_list(F.struct("row_idx", "col_idx", F.coalesce(value_col, F.lit("")).alias("v"))).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [_sheet([(c["row_idx"], c["col_idx"], c["v"]) for c in cs]) for cs in b["cells"]]})

    return rows.mapInPandas(run, "path string, content binary")


def _refilled_xlsx(content: bytes, values: dict[tuple[str, int, int], str]) -> bytes:
    """The workbook with the texts of given cells (sheet, row, column) changed in place; all else stays as it is."""
    ElementTree.register_namespace("", _X)
    source, out = zipfile.ZipFile(io.BytesIO(content)), io.BytesIO()
    sheet_of = {part: name for name, part in sheet_parts(source)}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for part in source.namelist():
            data = source.read(part)
            if part in sheet_of:
                root = ElementTree.fromstring(data)
                for c in root.iter(f"{{{_X}}}c"):
                    place = (sheet_of[part], *cell_place(c.get("r")))
                    if place in values and c.find(f"{{{_X}}}f") is None:
                        for child in [*c]:
                            c.remove(child)
                        c.set("t", "inlineStr")
                        text = ElementTree.SubElement(ElementTree.SubElement(c, f"{{{_X}}}is"), f"{{{_X}}}t")
                        text.text = values[place].replace(CELL_BREAK, "\n")
                data = ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)
            z.writestr(part, data)
    return out.getvalue()


def refill_xlsx(files: DataFrame, cells: DataFrame, value_col: str = "masked") -> DataFrame:
    """path and content of workbooks (path, content) with the changed cells (path, sheet, row_idx, col_idx, value, masked) in place.

    Cells whose masked text is their value stay untouched, with their type and format; so do formulas.
    """
    changed = cells.where(~F.col(value_col).eqNullSafe(F.col("value")))
    rows = changed.groupBy("path").agg(F.collect_list(F.struct("sheet", "row_idx", "col_idx", F.coalesce(value_col, F.lit("")).alias("v"))).alias("cells"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_refilled_xlsx(c, {(x["sheet"], x["row_idx"], x["col_idx"]): x["v"] for x in ([] if cs is None else cs)}) for c, cs in zip(b["content"], b["cells"], strict=True)]
            yield pd.DataFrame({"path": b["path"], "content": made})

    return files.select("path", "content").join(rows, "path", "left").mapInPandas(run, "path string, content binary")


def csv_line(columns: list) -> Column:
    """A line of quoted CSV: values with commas, quotes or line breaks are quoted, quotes doubled; null is empty."""
    quoted = lambda v: F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)
    return F.concat_ws(",", *(F.coalesce(quoted(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), F.lit("")) for c in columns))


def private_file(path: str, data: bytes) -> None:
    """A driver-side file that only its owner can read."""
    with os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "wb") as f:
        f.write(data)


def deliver(masked: DataFrame, folder: str, id_col: str = "doc_id") -> None:
    """What leaves the house for a batch: texts, mappings, review lists, audit records and their digests, each a table of files.

    ``masked`` is written once and read by every part. The mappings belong in another hand than the texts.
    """
    from ..operators import masking, review, second_pass
    from .storage import written

    rows = written(masked.select(id_col, "normal", "masked", "mapping"))
    parts = {
        "01_texts": rows.select(id_col, "masked"),
        "02_mapping": masking.mapping_rows(rows, id_col),
        "03_audit": second_pass.audit(rows, id_col),
        "04_review": review.report(rows, id_col),
        "05_sign_off": rows.select(id_col, F.sha2("masked", 256).alias("sha256"), F.size("mapping").alias("replacements")),
    }
    for name, part in parts.items():
        part.write.mode("overwrite").json(f"{folder}/{name}")
