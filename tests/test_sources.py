"""Readers, converters, encryption and streams on files made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from maskwright.functions import crypto
from maskwright.functions.text import html_to_text, leaks, repair_placeholders
from maskwright.sources import convert, readers, writers
from maskwright.streaming import mask_new_files


def _zip(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    x = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    (tmp_path / "a.docx").write_bytes(_zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>原告</w:t><w:t>张三</w:t></w:r></w:p><w:p/></w:body></w:document>'}))
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    sheet = f'<worksheet xmlns="{x}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>12.0</v></c><c r="C1"><f>A1</f><v>3</v></c><c r="AA2" t="b"><v>1</v></c></row></sheetData></worksheet>'
    (tmp_path / "b.xlsx").write_bytes(_zip({"xl/workbook.xml": f'<workbook xmlns="{x}"><sheets><sheet name="流水"/></sheets></workbook>', "xl/sharedStrings.xml": f'<sst xmlns="{x}"><si><t>户\n名</t></si></sst>', "xl/worksheets/sheet1.xml": sheet}))
    docs = {r.path.split("/")[-1]: r for r in readers.docx_texts(readers.files(spark, str(tmp_path), "*.docx")).collect()}
    assert docs["a.docx"].text == "原告张三\n" and docs["broken.docx"].error
    cells = [(r.sheet, r.row_idx, r.col_idx, r.value) for r in readers.xlsx_cells(readers.files(spark, str(tmp_path), "*.xlsx")).collect()]
    assert cells == [("流水", 1, 1, "户␊名"), ("流水", 1, 2, "12")]


def test_large_office_files_are_listed(spark, tmp_path):
    for name in ("a.docx", "a.xlsx"):
        with open(tmp_path / name, "wb") as f:
            f.truncate(readers.MAX_FILE_BYTES)
    (tmp_path / "small.docx").write_bytes(b"no archive")
    docs = {r.path.split("/")[-1]: r for r in readers.docx_texts(readers.files(spark, str(tmp_path), "*.docx")).collect()}
    assert set(docs) == {"a.docx", "small.docx"} and docs["a.docx"].text is None and str(readers.MAX_FILE_BYTES) in docs["a.docx"].error
    (cell,) = readers.xlsx_cells(readers.files(spark, str(tmp_path), "*.xlsx")).collect()
    assert cell.path.endswith("a.xlsx") and cell.sheet is None and cell.value is None and cell.error


def test_cases_skip_what_is_no_case(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('# note\n\n{"id": "a", "text": "t", "expect_absent": ["x"]}\n{broken\n')
    (row,) = readers.cases(spark, str(tmp_path / "c.jsonl")).collect()
    assert row.id == "a" and row.expect_masked == [] and row.expect_absent == ["x"]


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note\n"a,b",c\n')
    assert convert.csv_to_json(spark, str(tmp_path / "a.csv")).first().json == '{"name":"a,b","note":"c"}'
    (tmp_path / "b.csv").write_text("__proto__,b\n1,2\n")
    with pytest.raises(ValueError):
        convert.csv_to_json(spark, str(tmp_path / "b.csv"))


def test_flatten_refuses_colliding_paths(spark):
    df = spark.createDataFrame([((1, [1, 2]),)], "a struct<b:int,c:array<int>>")
    assert convert.flatten(df).first().asDict() == {"a.b": "1", "a.c": "[1,2]"}
    with pytest.raises(ValueError):
        convert.flatten(spark.createDataFrame([((1,), 2)], "a struct<b:int>, `a.B` int"))


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(html_to_text(F.lit("<p>a&amp;b</p><script>x</script>c<br>d"))) == "a&b\nc\nd"
    assert one(repair_placeholders(F.lit("甲[占 位\n符]乙 丙"))) == "甲[占位符]乙 丙"
    assert one(leaks(F.lit("xx345678yy"), F.lit("12345678"))) is True
    assert one(leaks(F.lit("xx34567yy"), F.lit("12345678"))) is False
    assert one(convert.markdown_to_html(F.lit("# t\n**b** <i> [x](javascript:1)"))) == "<h1>t</h1>\n<p><strong>b</strong> &lt;i&gt; [x](javascript:1)</p>"


def test_encryption(spark):
    key = crypto.derive_key("secret", b"s" * 32, 1000)
    df = spark.createDataFrame([("映射", key, b"0" * 32)], "text string, key binary, wrong binary")
    data = df.withColumn("data", crypto.encrypt(F.col("text"), F.col("key")))
    assert data.select(crypto.decrypt(F.col("data"), F.col("key"))).first()[0] == "映射"
    assert data.select(crypto.decrypt(F.col("data"), F.col("wrong"))).first()[0] is None


def test_endpoints_fail_closed():
    crypto.check_endpoint("http://127.0.0.1:11434")
    crypto.check_endpoint("")
    for url in ("https://example.com/v1", "example.com"):
        with pytest.raises(PermissionError):
            crypto.check_endpoint(url)
    with pytest.raises(ValueError):
        crypto.check_endpoint("", allow_remote=True, offline=True)


def test_stream_resumes(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    spark.createDataFrame([(1, "13800138000")], "doc_id long, text string").write.parquet(src)
    schema = spark.read.parquet(src).schema
    mask_new_files(spark, src, schema, out, log)
    spark.createDataFrame([(2, "a@b.com")], "doc_id long, text string").write.mode("append").parquet(src)
    mask_new_files(spark, src, schema, out, log)
    assert {(r.doc_id, r.masked) for r in spark.read.parquet(out).collect()} == {(1, "[手机号]"), (2, "[邮箱]")}


def test_office_files_written_back(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    doc = _zip({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>原告</w:t><w:t>张三</w:t></w:r></w:p><w:p><w:r><w:t>完</w:t></w:r></w:p></w:body></w:document>', "word/header1.xml": f'<w:hdr xmlns:w="{w}"><w:p><w:r><w:t>机密</w:t></w:r></w:p></w:hdr>', "docProps/core.xml": "<a/>"})
    (row,) = writers.refill_docx(spark.createDataFrame([("a", doc, "原告[当事人甲（原告）]\n完")], "path string, content binary, masked string")).collect()
    z = zipfile.ZipFile(io.BytesIO(bytes(row.content)))
    assert readers._docx(bytes(row.content)) == "原告[当事人甲（原告）]\n完" and "机密" not in z.read("word/header1.xml").decode() and "docProps/core.xml" not in z.namelist()
    cells = spark.createDataFrame([("b", 1, 1, "a<b"), ("b", 2, 28, "x")], "path string, row_idx int, col_idx int, masked string")
    (row,) = writers.xlsx(cells).collect()
    assert readers._xlsx(bytes(row.content)) == [("Sheet1", 1, 1, "a<b"), ("Sheet1", 2, 28, "x")]
    writers.private_file(str(tmp_path / "key"), b"k")
    assert (tmp_path / "key").stat().st_mode & 0o777 == 0o600


def test_html_to_markdown(spark):
    html = '<h2>t</h2><p>a <b>b</b></p><ul><li>x</li></ul><a href="https://e.example">l</a><a href="javascript:1">m</a>'
    assert spark.range(1).select(convert.html_to_markdown(F.lit(html))).first()[0] == "## t\n\na **b**\n- x\n[l](https://e.example)m"


def test_workbooks_are_refilled_in_place(spark):
    """Sheets are found by their relations; untouched cells, formulas and other parts stay as they are."""
    x, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    sheet = f'<worksheet xmlns="{x}"><sheetData><row r="1"><c r="A1" t="s" s="3"><v>0</v></c><c r="B1"><v>12</v></c><c r="C1"><f>B1*2</f><v>24</v></c></row></sheetData><mergeCells count="1"><mergeCell ref="A1:A2"/></mergeCells></worksheet>'
    content = _zip({
        "xl/workbook.xml": f'<workbook xmlns="{x}" xmlns:r="{r}"><sheets><sheet name="流水" sheetId="1" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{rels}"><Relationship Id="rId7" Type="{r}/worksheet" Target="worksheets/other.xml"/></Relationships>',
        "xl/sharedStrings.xml": f'<sst xmlns="{x}"><si><t>张三</t></si></sst>', "xl/worksheets/other.xml": sheet, "xl/theme.xml": "<t/>",
    })
    assert readers._xlsx(content) == [("流水", 1, 1, "张三"), ("流水", 1, 2, "12")]
    files = spark.createDataFrame([("p", bytearray(content)), ("q", bytearray(content))], "path string, content binary")
    cells = spark.createDataFrame([("p", "流水", 1, 1, "张三", "[当事人_1]"), ("p", "流水", 1, 2, "12", "12")], "path string, sheet string, row_idx int, col_idx int, value string, masked string")
    out = {f.path: bytes(f.content) for f in writers.refill_xlsx(files, cells).collect()}
    assert readers._xlsx(out["p"]) == [("流水", 1, 1, "[当事人_1]"), ("流水", 1, 2, "12")] and readers._xlsx(out["q"]) == readers._xlsx(content)
    parts = zipfile.ZipFile(io.BytesIO(out["p"]))
    changed = parts.read("xl/worksheets/other.xml").decode()
    assert parts.read("xl/theme.xml") == b"<t/>" and 's="3"' in changed and "mergeCell" in changed and "B1*2" in changed


def test_pages_by_a_plugged_reader(spark, tmp_path):
    from maskwright.operators import boxes

    (tmp_path / "a.txt").write_bytes(b"one two\nthree")
    (tmp_path / "b.txt").write_bytes(b"!")

    def factory():
        def read(content):
            if content == b"!":
                raise ValueError("broken")
            return [(1, w, 0.1 * i, 0.9 - 0.1 * k, 0.1, 0.02) for k, line in enumerate(content.decode().split("\n")) for i, w in enumerate(line.split())]

        return read

    found = readers.page_boxes(readers.files(spark, str(tmp_path)), factory)
    assert [r.error for r in found.where("error IS NOT NULL").collect()] == ["ValueError('broken')"]
    lines = boxes.text_lines(found.where("error IS NULL").withColumnRenamed("path", "doc_id")).orderBy("line").collect()
    assert [r.text for r in lines] == ["one two", "three"]


def test_delivery(spark, tmp_path):
    from maskwright.operators import masking

    docs = spark.createDataFrame([(1, "联系 13800138000 。"), (2, "无")], "doc_id long, text string")
    writers.deliver(masking.mask(docs), str(tmp_path / "out"))
    read = lambda part: {r.doc_id: r for r in spark.read.json(str(tmp_path / "out" / part)).collect()}
    assert read("01_texts")[1].masked == "联系 [手机号] 。" and read("02_mapping")[1].original == "13800138000"
    assert set(read("04_review")) == {1, 2} and read("05_sign_off")[2].replacements == 0


def test_recognisers_of_replies_and_types(spark):
    import json

    from maskwright.operators import recognisers

    ask = lambda text: json.dumps([{"type": "PERSON", "text": "张三"}, {"type": "COURT", "text": "临平法院"}, {"type": "PERSON", "text": "李四"}]) if "张三" in text else "no"
    df = spark.createDataFrame([(1, "张三诉至临平法院，张三到庭"), (2, "无人")], "doc_id long, text string")
    masked = {r.doc_id: r.masked for r in recognisers.mask_entities(recognisers.recognise(df, recognisers.reply_recogniser(ask))).collect()}
    assert masked == {1: "[当事人_1]诉至[审理法院]，[当事人_1]到庭", 2: "无人"}
    courts = recognisers.recognise(df, recognisers.only(recognisers.reply_recogniser(ask), ("COURT",)))
    assert {r.doc_id: r.masked for r in recognisers.mask_entities(courts).collect()}[1] == "张三诉至[审理法院]，张三到庭"
