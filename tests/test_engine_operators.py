"""Boxes, batches and model calls."""

import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from maskwright.operators import batching, boxes, masking, second_pass


def test_boxes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(F.regexp(F.lit("见 138 0013 8000 号"), boxes.value_pattern(F.lit("13800138000")))) is True
    assert one(F.regexp(F.lit("9138001380007"), boxes.value_pattern(F.lit("13800138000")))) is False
    assert one(boxes.still_readable(F.lit("张 三 在"), F.array(F.lit("张三"), F.lit("李四"), F.lit("-")))) == ["张三"]
    struct = lambda *v: F.struct(*(F.lit(float(x)).alias(n) for n, x in zip("xywh", v, strict=True)))
    assert one(boxes.covered(struct(0, 0, 1, 1), struct(0, 0, 1, 0.9))) is True
    assert one(boxes.covered(struct(0, 0, 1, 1), struct(0, 0, 1, 0.5))) is False


def test_lines_of_boxes(spark):
    rows = [(1, 1, "b", 0.5, 0.90), (1, 1, "a", 0.1, 0.905), (1, 1, "c", 0.1, 0.5), (2, 1, "d", 0.0, 0.1)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, x double, y double")
    assert sorted((r.doc_id, r.line, r.text) for r in boxes.text_lines(df).collect()) == [(1, 0, "a b"), (1, 1, "c"), (2, 0, "d")]


def test_batches_resume(spark, tmp_path):
    src, out, log = (str(tmp_path / n) for n in ("src", "out", "log"))
    spark.createDataFrame([("a", "13800138000"), ("b", "x")], "path string, text string").write.parquet(src)
    assert {(r.path, r.replaced) for r in batching.run(spark, src, out, log).collect()} == {("a", 1), ("b", 0)}
    spark.createDataFrame([("c", "a@b.com")], "path string, text string").write.mode("append").parquet(src)
    assert batching.run(spark, src, out, log).count() == 3
    assert batching.run(spark, src, out, log).count() == 3
    spark.read.parquet(f"{out}").where("path = 'a'").drop("run").write.parquet(f"{out}/run=died")  # a run that ended before its log
    assert sorted((r.path, r.masked) for r in batching.results(spark, out, log).collect()) == [("a", "[手机号]"), ("b", "x"), ("c", "[邮箱]")]


def test_model_calls(spark):
    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b'{"choices": [{"message": {"content": "ok"}}]}')

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    df = masking.mask(spark.createDataFrame([(1, "x")], "doc_id int, text string"))
    got = second_pass.call_model(df, f"http://127.0.0.1:{server.server_port}", "m").first()
    server.shutdown()
    assert got.reply == "ok" and got.error is None
    assert second_pass.call_model(df, "http://127.0.0.1:9", "m").first().error
    with pytest.raises(PermissionError):
        second_pass.call_model(df, "https://models.example", "m")
