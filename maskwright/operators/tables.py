"""Tables by column: headers name the kinds of columns, and each kind has its own rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import markup
from ..functions.markup import let
from ..functions.text import preprocess
from ..plans.catalog import HAN
from ..sources.storage import written
from . import entities, masking

# Header words by kind of column; the first kind that has one wins.
COLUMN_KINDS = (
    ("户名", "账号与户名 账号及户名 对方户名 交易对手 对方名称 户名 收款人 付款人 交易对方 对方账号与户名 往来单位".split()),
    ("日期", "交易日期 记账日期 业务日期 日期".split()),
    ("金额", "交易金额 账户余额 余额 金额 收入 支出 发生额 借方 贷方".split()),
    ("附言", "附言 摘要 备注 用途 地点".split()),
)
DEFAULT_KIND = "默认"
LEAST_KNOWN_HEADERS = 2


def column_kind(header: Column) -> Column:
    out = F.lit(DEFAULT_KIND)
    for kind, words in reversed(COLUMN_KINDS):
        out = F.when(F.coalesce(header, F.lit("")).rlike("|".join(words)), kind).otherwise(out)
    return out


def is_table(headers: Column) -> Column:
    """Whether enough headers are known."""
    return F.size(F.filter(headers, lambda h: column_kind(h) != DEFAULT_KIND)) >= LEAST_KNOWN_HEADERS


def cells(df: DataFrame, id_cols: list[str], headers: dict[str, str], row_col: str) -> DataFrame:
    """A wide table as cells: ids, row_idx, col_idx, header, col_type, value."""
    entries = [F.struct(F.lit(i).alias("col_idx"), F.lit(h).alias("header"), F.col(c).cast("string").alias("value")) for i, (c, h) in enumerate(headers.items())]
    rows = df.select(*id_cols, F.col(row_col).alias("row_idx"), F.explode(F.array(*entries)).alias("c")).select(*id_cols, "row_idx", "c.*")
    return rows.withColumn("col_type", column_kind(F.col("header")))


def offsets(cell_table: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Each cell's place in the flattened text of its document, cells joined by line breaks."""
    before = Window.partitionBy(doc_col).orderBy("row_idx", "col_idx").rowsBetween(Window.unboundedPreceding, -1)
    return cell_table.withColumn("offset", F.coalesce(F.sum(F.length(F.coalesce("value", F.lit(""))) + 1).over(before), F.lit(0)))


def header_cells(cell_table: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """A cell for each header of each table, in a row before all others; headers are text of no kind."""
    firsts = cell_table.groupBy(doc_col, "col_idx", "header").agg(F.min("row_idx").alias("row_idx"))
    first = Window.partitionBy(doc_col)
    return firsts.select(doc_col, (F.min("row_idx").over(first) - 1).alias("row_idx"), "col_idx", "header", F.col("header").alias("value"), F.lit(DEFAULT_KIND).alias("col_type")).select(*cell_table.columns)


def _marked_cell(kind: Column) -> Column:
    """The cell ``normal`` with marked spans: dates stay, remarks keep their numbers, a lone name in a column of names is a counterparty."""
    value = F.col("normal")
    lone = kind.isin("户名", "附言") & value.rlike(f"^[{HAN}]{{2,4}}$") & entities.surname_led(value) & entities.plausible(value, F.lit(""))
    return (
        F.when(kind == "日期", value)
        .when(lone, entities.person_span(value, masking.CODES))
        .when(kind == "附言", masking.marked_normal(masking.Options(amounts=False, bare_names=False)))
        .otherwise(masking.marked_normal())
    )


def _masked_values(cell_table: DataFrame) -> DataFrame:
    """The different values of each kind of column, masked: ``_value``, ``_kind``, ``masked``, ``mapping``, ``names`` and ``_gaps``.

    Each is a long way through the rules, so they are dealt to all tasks, however few they are.
    """
    spark = cell_table.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    different = cell_table.select("_value", "_kind").distinct().repartition(tasks, "_value", "_kind")
    marked = different.withColumn("normal", markup.unmarked_input(preprocess(F.col("_value")))).withColumn("_m", _marked_cell(F.col("_kind")))
    return written(marked.withColumn("_r", masking.assembled_marks()).select("_value", "_kind", "_r.masked", "_r.mapping", "_r.names", markup.gaps(F.col("_m")).alias("_gaps")))


def mask_table(cell_table: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Adds ``masked`` and ``mapping``; entities are those of the whole table.

    Cells are written, and their different values masked by themselves, once each, and written. The names
    of the cells, a row for each different one, are numbered by first appearance in
    their table: people by a window over the different names of a table, companies, which link by
    stem and containment, by a fold over those. Placeholders then meet the cells that hold names by document and name.
    """
    keep = [c for c in cell_table.columns if c not in ("masked", "mapping")]
    place = F.struct("row_idx", "col_idx", F.col("n.ord").alias("ord"))
    cell_table = written(cell_table.select(*keep, F.coalesce(F.col("value").cast("string"), F.lit("")).alias("_value"), F.coalesce(F.col("col_type"), F.lit(DEFAULT_KIND)).alias("_kind")))
    base = written(cell_table.join(_masked_values(cell_table), ["_value", "_kind"]).select(*keep, "masked", "mapping", "names", "_gaps"))

    mentions = base.where(F.size("names") > 0).select(doc_col, "row_idx", "col_idx", F.explode("names").alias("n")).select(doc_col, place.alias("at"), F.col("n.name").alias("name"), F.col("n.role").alias("role"), F.col("n.entity").startswith("person").alias("person"))
    with_role = F.when(F.col("role") != "", F.col("at"))
    firsts = written(mentions.groupBy(doc_col, "person", "name").agg(F.min("at").alias("first"), F.min(with_role).alias("role_at"), F.min_by("role", with_role).alias("role")))
    people = firsts.where("person").select(
        doc_col, "person", "name", F.concat(F.lit("person_"), F.row_number().over(Window.partitionBy(doc_col).orderBy("first")).cast("string")).alias("entity"), "role", "role_at"
    )
    found = F.array_sort(F.collect_list(F.struct("first", "name", F.coalesce("role", F.lit("")).alias("role"), "role_at")))
    companies = firsts.where("NOT person").groupBy(doc_col).agg(found.alias("f"))
    folded = let(
        F.col("f"),
        lambda f: F.zip_with(
            f, entities.fold(F.transform(f, lambda x, i: F.struct(F.lit(0).alias("rule"), i.alias("ord"), F.lit(False).alias("person"), x["name"].alias("canonical"), x["role"].alias("role")))),
            lambda x, r: F.struct(x["name"].alias("name"), r["entity"].alias("entity"), x["role"].alias("role"), x["role_at"].alias("role_at")),
        ),
    )
    linked = companies.select(doc_col, F.explode(folded).alias("c")).select(doc_col, F.lit(False).alias("person"), "c.*")
    # a company's role is the first that any of its names has
    of_entity = Window.partitionBy(doc_col, "entity")
    linked = linked.withColumn("role", F.min_by("role", "role_at").over(of_entity)).withColumn("role_at", F.min("role_at").over(of_entity))
    known = people.unionByName(linked.select(*people.columns))

    # a merge: equal cells are far larger than their files, whose size would have them broadcast
    asked = base.where(F.size("names") > 0).select(*keep, "mapping", "_gaps", F.explode("names").alias("n")).withColumn("at", place)
    asked = asked.withColumn("name", F.col("n.name")).withColumn("person", F.col("n.entity").startswith("person"))
    bound = F.when(F.col("at") >= F.col("role_at"), F.col("role")).otherwise(F.lit(""))
    shown = asked.join(known.hint("merge"), [doc_col, "person", "name"]).withColumn("_shown", entities.placeholder(F.col("entity"), F.coalesce(bound, F.lit(""))))
    ids = [c for c in keep if c in (doc_col, "row_idx", "col_idx")]
    rest = [c for c in keep if c not in ids]
    back = shown.groupBy(*ids).agg(*(F.first(c).alias(c) for c in (*rest, "mapping", "_gaps")), F.map_from_entries(F.collect_list(F.struct(F.col("n.ord"), "_shown"))).alias("_by"))
    renamed = F.transform("mapping", lambda m: m.withField("replacement", F.coalesce(F.element_at("_by", m["ord"] - 1), m["replacement"])))
    back = back.withColumn("mapping", renamed).withColumn("masked", markup.weave(F.col("_gaps"), F.transform("mapping", lambda m: m["replacement"])))
    return base.where(F.size("names") == 0).select(*keep, "masked", "mapping").unionByName(back.select(*keep, "masked", "mapping"))
