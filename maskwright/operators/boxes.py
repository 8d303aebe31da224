"""Boxes of recognised text against sensitive values, and coverage of boxes by redactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def solid(value: Column) -> Column:
    return F.regexp_replace(value, r"\s", "")


def noisy(value: Column) -> Column:
    """Values of fewer than two letters, digits or Han characters say nothing."""
    return F.length(F.regexp_replace(value, "[^一-龥A-Za-z0-9]", "")) < 2


def sensitive_boxes(boxes: DataFrame, values: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Boxes of a document whose text holds one of its values, blanks aside. An equi-join on the document."""
    wanted = values.where(~noisy(F.col("value"))).select(id_col, "value").distinct()
    return boxes.join(wanted, id_col).where(F.contains(solid(F.col("text")), solid(F.col("value"))))


def redaction_counts(boxes: DataFrame, values: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """outcome, placeholder and n by document: boxes that a value's redaction covers, values no box shows (not_found), values that say nothing (skipped)."""
    hit = sensitive_boxes(boxes, values.select(id_col, "value")).join(values.select(id_col, "value", "placeholder").distinct(), [id_col, "value"])
    noise = noisy(F.col("value"))
    lost = values.where(~noise).select(id_col, "value", "placeholder").distinct().join(hit.select(id_col, "value").distinct(), [id_col, "value"], "left_anti")
    parts = {"redacted": hit, "not_found": lost, "skipped": values.where(noise)}
    rows = [d.select(id_col, F.lit(name).alias("outcome"), "placeholder") for name, d in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(id_col, "outcome", "placeholder").agg(F.count("*").alias("n"))


def longest_first(values: Column) -> Column:
    """Values in the order in which they are looked for: longer ones first, so that no part is taken before the whole."""
    return F.transform(F.array_sort(F.transform(F.array_distinct(values), lambda v: F.struct((-F.length(v)).alias("k"), v.alias("v")))), lambda x: x["v"])


def covered(box: Column, cover: Column, share: float = 0.85) -> Column:
    """Whether a cover (struct x, y, w, h) takes in that share of a box."""
    side = lambda a, n: F.greatest(F.lit(0.0), F.least(box[a] + box[n], cover[a] + cover[n]) - F.greatest(box[a], cover[a]))
    return side("x", "w") * side("y", "h") >= share * box["w"] * box["h"]


def value_pattern(value: Column) -> Column:
    """A pattern for a value with blanks allowed between its characters; identifiers end at word borders."""
    chars = F.array_join(F.transform(F.filter(F.split(solid(value), ""), lambda c: c != ""), lambda c: F.concat(F.lit(r"\Q"), c, F.lit(r"\E"))), r"\s*")
    return F.when(solid(value).rlike(r"^[A-Za-z0-9]+$"), F.concat(F.lit("(?<![A-Za-z0-9])"), chars, F.lit("(?![A-Za-z0-9])"))).otherwise(chars)


def still_readable(text: Column, values: Column) -> Column:
    """Values of an array that a text still shows, blanks aside; ones that say nothing are left out."""
    return F.filter(values, lambda v: ~noisy(v) & F.contains(solid(text), solid(v)))


def text_lines(boxes: DataFrame, id_col: str = "doc_id", gap: float = 0.02) -> DataFrame:
    """Lines of recognised text: a box joins the line whose running mean height it is nearest to within ``gap``.

    A page's boxes are folded from top to bottom; a page is bounded by what fits on paper.
    """
    box = F.struct((-F.col("y")).alias("top"), "x", "text")
    pages = boxes.groupBy(id_col, "page").agg(F.array_sort(F.collect_list(box)).alias("bs"))
    line = "struct<sum:double,n:int,words:array<struct<x:double,text:string>>>"
    start = F.array().cast(f"array<{line}>")

    def step(acc: Column, b: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        word = F.array(F.struct(b["x"].alias("x"), b["text"].alias("text")))
        fits = F.coalesce(F.abs(last["sum"] / last["n"] - b["top"]) < gap, F.lit(False))
        joined = F.struct((last["sum"] + b["top"]).alias("sum"), (last["n"] + 1).alias("n"), F.concat(last["words"], word).alias("words"))
        fresh = F.struct(b["top"].alias("sum"), F.lit(1).alias("n"), word.alias("words"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), F.array(joined))).otherwise(F.concat(acc, F.array(fresh)))

    shown = lambda ws: F.array_join(F.transform(F.array_sort(ws), lambda w: w["text"]), " ")
    rows = pages.select(id_col, "page", F.posexplode_outer(F.aggregate("bs", start, step)).alias("line", "l")).where("l IS NOT NULL")
    return rows.select(id_col, "page", "line", shown(F.col("l.words")).alias("text"))
