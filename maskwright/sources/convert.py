"""Conversion between text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import html_to_text


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted paths of a nested schema's leaves; arrays and maps are leaves."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaf_paths(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [(path, f.dataType)]
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Nested columns as dotted columns in sorted order; arrays and maps as JSON. Colliding paths are an error."""
    leaves = sorted(leaf_paths(df.schema))
    names = [p for p, _ in leaves]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("two paths have the same name")

    def column(path: str, kind: T.DataType):
        whole = F.col(".".join(f"`{p}`" for p in path.split(".")))
        return (F.to_json(whole) if isinstance(kind, (T.ArrayType, T.MapType)) else whole.cast("string")).alias(path)

    return df.select(*(column(p, k) for p, k in leaves))


def json_to_table(df: DataFrame, json_col: str, schema: str) -> DataFrame:
    """The objects of a JSON column as a flat table."""
    return flatten(df.select(F.from_json(json_col, schema).alias("j")).select("j.*"))


def csv_to_json(spark: SparkSession, path: str) -> DataFrame:
    """Strict CSV with a header as JSON objects; headers that repeat, case aside, are an error."""
    rows = spark.read.option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)
    seen = [c.lower() for c in rows.columns]
    if len(set(seen)) < len(seen) or {"__proto__", "constructor", "prototype"} & set(seen):
        raise ValueError("unsafe or repeated header")
    return rows.select(F.to_json(F.struct(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in rows.columns))).alias("json"))


def markdown_to_html(text):
    """Headings, bold, safe links and paragraphs; raw tags are escaped."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    for level in range(6, 0, -1):
        out = F.regexp_replace(out, rf"(?m)^#{{{level}}} +(.+)$", f"<h{level}>$1</h{level}>")
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    out = F.regexp_replace(out, r"\[([^\]]+)\]\(((?:https?://|mailto:)[^)\s]+)\)", '<a href="$2">$1</a>')
    return F.regexp_replace(out, r"(?m)^(?!<h[1-6]>)(.+)$", "<p>$1</p>")


def html_to_markdown(html):
    """Headings, bold, items and safe links of a page as Markdown; everything else as text."""
    out = F.coalesce(html, F.lit(""))
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n" + "#" * level + " $1\n\n")
    out = F.regexp_replace(out, r"(?is)<(?:b|strong)>(.*?)</(?:b|strong)>", "**$1**")
    out = F.regexp_replace(out, r"(?is)<li[^>]*>(.*?)</li>", "- $1\n")
    out = F.regexp_replace(out, r'(?is)<a [^>]*href="((?:https?://|mailto:)[^"]*)"[^>]*>(.*?)</a>', "[$2]($1)")
    return html_to_text(out)


def markdown_to_text(text):
    """Markdown without its marks: headings, bold, items, links as their words."""
    out = F.regexp_replace(text, r"(?m)^#{1,6} +|^[-*] +|^> ?", "")
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*|`([^`]+)`", "$1$2")
    return F.regexp_replace(out, r"\[([^\]]+)\]\([^)\s]+\)", "$1")


def text_to_html(text):
    """Paragraphs of escaped text."""
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.regexp_replace(out, r"(?m)^(.+)$", "<p>$1</p>")


#: (from, to) -> conversion of a text column. Tables, CSV and JSON, are converted by ``csv_to_json`` and ``json_to_table``.
CONVERSIONS = {
    ("txt", "md"): lambda t: t, ("txt", "html"): text_to_html, ("md", "txt"): markdown_to_text, ("md", "html"): markdown_to_html,
    ("html", "txt"): html_to_text, ("html", "md"): html_to_markdown,
}


def convert(text, source: str, target: str):
    """A text column in another format; an unknown pair is an error."""
    if source == target:
        return text
    if (source, target) not in CONVERSIONS:
        raise ValueError(f"no conversion from {source} to {target}")
    return CONVERSIONS[source, target](text)
