"""Line-first quality rules, in DataFrame functions only.

A text is split into lines. Each line with a word is judged by itself: by punctuation (ten words
or more need a mark for every forty), as navigation (short items between separators), and
as boilerplate (site notices), symbol junk or shouting. Failed lines are removed; a document that
loses too large a part of its characters is rejected. Before that, a document fails on counts of its own: too
few words, or too many words inside repeated three-word windows.

Everything is a function of one row: no shuffle, no Python, whole texts. Repeated windows are found by
sorting a row's window hashes, so a long text costs n log n.

Defined results: a null or empty text has no words and is rejected for that; null ids pass through;
repeated rows give equal results; an empty table gives an empty result; other columns pass through
``clean`` and are ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Word separators, symbols, thresholds.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30
NAV_WORDS = 40

# Notices that make a line boilerplate wherever they stand.
BOILERPLATE = (
    r"(?i)^\s*(copyright\b|all rights reserved|cookie (policy|settings)|terms of (use|service)|privacy policy|subscribe (now|to our)|click here|sign (in|up)\b|log ?in\b|skip to (main )?content|enable javascript"
    r"|alle rechte vorbehalten|datenschutzerkl|impressum\b|nutzungsbedingungen|jetzt abonnieren|hier klicken|zum inhalt springen"
    r"|tous droits r[ée]serv|mentions l[ée]gales|politique de confidentialit|conditions d.utilisation|abonnez-vous|cliquez ici|aller au contenu"
    r"|todos los derechos reservados|aviso legal|pol[ií]tica de (privacidad|cookies)|t[ée]rminos (de uso|y condiciones)|suscr[ií]bete|haz clic aqu|saltar al contenido)"
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows found twice or more.

    Windows are told apart by 64-bit hashes of their words. Sorted with their positions, equal ones are
    neighbours. Texts whose windows are all different, most of them, need no sort.
    """
    n = F.size(words)

    def windows(w: Column) -> Column:
        return F.when(
            F.size(w) >= 4,
            F.slice(F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))), F.lit(1), F.size(w) - 2),
        ).otherwise(F.array().cast("array<bigint>"))

    def found(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def twice(p: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
            return F.transform(F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["at"])

        return let(F.array_sort(let(placed, twice)), covered)

    def covered(s: Column) -> Column:
        return F.when(F.size(s) == 0, F.lit(0)).otherwise(
            F.aggregate(s, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("end")), lambda acc, p: F.struct((acc["n"] + F.least(F.lit(3), p + 3 - acc["end"])).alias("n"), (p + 3).alias("end")), lambda acc: acc["n"])
        )

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(found(hashes))

    return F.when(n < 4, F.lit(0)).otherwise(let(windows(words), counted)).cast("long")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: a one-element array's transform binds it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def line_verdict(line: Column) -> Column:
    """Why a line fails, or an empty string. A line's words are its spaces plus one."""
    trimmed = F.trim(line)

    def judge(n_words: Column) -> Column:
        count = lambda others: F.length(F.regexp_replace(trimmed, others, ""))
        bars, marks = count(r"[^|»›•·]+"), count(r"[^.,;:!?…。！？]+")
        odd = (
            F.when((bars >= 1) & (bars * 8 >= n_words), "navigation")
            .when(count(r"[^#*$%&|<>]+") * 4 > n_words, "symbols")
            .when((F.size(F.split(trimmed, "!!")) - 1) * 3 > n_words, "shouting")
        )
        return (
            F.when(trimmed.rlike(BOILERPLATE), "boilerplate")
            .when(trimmed.rlike(r"[|»›•·#*$%&<>]|!!") & odd.isNotNull(), odd)
            .when((n_words >= NAV_WORDS // 4) & (marks * NAV_WORDS < n_words), "punctuation")
            .otherwise("")
        )

    return let(F.length(trimmed) - F.length(F.replace(trimmed, F.lit(" "), F.lit(""))) + 1, judge)


def lines_of(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measure(docs: DataFrame, text_col: str = "text", name: str = "quality", with_rest: bool = False) -> DataFrame:
    """Adds a struct ``name`` with the counts and verdicts; it replaces a column so named. With ``with_rest`` it holds the text without failed lines as well."""
    text = F.col(text_col)
    per_row = let(
        lines_of(text),
        lambda lines: let(
            F.transform(lines, lambda x: F.struct(F.length(F.trim(x)).alias("chars"), line_verdict(x).alias("why"), *([x.alias("line")] if with_rest else []))),
            lambda judged: F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _chars(judged, lambda x: F.lit(True)).alias("line_chars"),
                _chars(judged, lambda x: x["why"] != "").alias("lost_chars"),
                F.array_distinct(F.transform(F.filter(judged, lambda x: x["why"] != ""), lambda x: x["why"])).alias("reasons"),
                *([F.array_join(F.transform(F.filter(judged, lambda x: x["why"] == ""), lambda x: x["line"]), "\n").alias("rest")] if with_rest else []),
            ),
        ),
    )
    per_word = let(
        words_of(text),
        lambda words: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda acc, w: acc + F.length(w)).alias("word_chars"),
            repeat_words(words).alias("n_repeat_words"),
        ),
    )
    out = docs.withColumn("_mw_lines", per_row).withColumn("_mw_words", per_word)
    failed = (F.col("_mw_words.n_words") < MIN_WORDS) | (100 * F.col("_mw_words.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_mw_words.n_words"))
    lost = 100 * F.col("_mw_lines.lost_chars") > MAX_LOST_PERCENT * F.col("_mw_lines.line_chars")
    return out.withColumn(
        name,
        F.struct(
            F.col("_mw_words.n_words"), F.col("_mw_words.word_chars"),
            F.coalesce(F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")), F.lit(0)).cast("long").alias("n_symbols"),
            F.col("_mw_lines.n_dup_lines"), F.col("_mw_words.n_repeat_words"), failed.alias("base_failed"),
            (~failed & ~lost).alias("kept"),
            F.col("_mw_lines.line_chars"), F.col("_mw_lines.lost_chars"), F.col("_mw_lines.reasons"), *([F.col("_mw_lines.rest")] if with_rest else []),
        ),
    ).drop("_mw_lines", "_mw_words")


def _chars(judged: Column, keep) -> Column:
    return F.aggregate(F.filter(judged, keep), F.lit(0).cast("long"), lambda acc, x: acc + x["chars"])


def clean(docs: DataFrame, text_col: str = "text", replace_text: bool = False) -> DataFrame:
    """The documents that pass, with their columns; with ``replace_text`` without their failed lines."""
    out = measure(docs, text_col, "_mw_quality", with_rest=replace_text)
    # generated, not filtered: a filter would be pushed below the measures and take them a second time
    passed = F.explode_outer(F.filter(F.array("_mw_quality"), lambda q: q["kept"]))
    out = out.select(*(docs[c] for c in docs.columns), passed.alias("_mw_passed")).where("_mw_passed IS NOT NULL")
    if replace_text:
        out = out.withColumn(text_col, F.when(F.col("_mw_passed.lost_chars") > 0, F.col("_mw_passed.rest")).otherwise(F.col(text_col)))
    return out.select(*docs.columns)


def op2_line_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ._shared import documents

    return measure(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines",
        "quality.n_repeat_words", "quality.base_failed", "quality.kept", "quality.line_chars", "quality.lost_chars",
    )
