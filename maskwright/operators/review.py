"""Review of masked texts: what sensitive looks are left, by tier, and whether originals survive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import MID as HOLD
from ..functions.markup import SEP, let
from ..functions.text import leaks
from ..plans.catalog import CRITICAL_KINDS, HAN
from .entities import NOT_NAMES, surname_led
from .masking import _PROJECT_GENERIC, _PROJECT_NEVER_FIRST
from .restore import restored

# Families of residues, with the group that is judged, in order.
FAMILIES = (
    ("法院名称", rf"[{HAN}]{{2,12}}?(?:人民法院|中级人民法院|高级人民法院|法院)"),
    ("角色词人名残留", rf"(?:原告|被告|上诉人|被上诉人|案外人|证人|法定代表人|负责人|审判员|书记员|委托诉讼代理人|委托代理人|项目经理|财务人员|发包人|承包人|分包人)[：:，,， ]*[{HAN}]{{2,4}}"),
    ("公司/机构简称残留", rf"(?<![{HAN}A-Za-z0-9\]])[{HAN}]{{2,8}}(?:公司|事务所|集团|商行|经营部|服务部|商店|店|商铺|超市|宾馆|饭店)"),
    ("地址残留", rf"[{HAN}]{{1,3}}(?:省|自治区)[{HAN} ]{{1,12}}(?:市)[{HAN} ]{{1,12}}(?:区|县|市|镇)[{HAN}\d\- ]{{3,30}}(?:号|室|层)|[{HAN}]{{2,10}}(?:路|街|大道|巷)[{HAN}\d\-]{{1,10}}(?:号|栋|弄)"),
    ("项目名称残留", rf"[{HAN}]{{2,6}}(?:项目|小区|大厦|花园|公寓|家园|新村|广场|商城)"),
    ("金额残留", r"(?<!\d)(?<!\d[,，.])\d[\d,，.]{3,}[ \t]*[万千亿]?[ \t]*(?:元|美元|欧元)|(?<!\d)(?!(?:19|20)\d{6})\d{7,}(?:\.\d{1,3})?(?!\d)"),
    ("案号", rf"[（(]\d{{4}}[）)]\s*[{HAN}]{{1,12}}\s*\d{{1,8}}\s*号"),
    ("身份证号/手机号/银行账号", r"(?<!\d)(?:1[3-9]\d{9}|\d{17}[\dXx]|\d{14,20})(?!\d)"),
    ("提示注入模式", r"(?:忽略|无视|忘记)(?:之前|以上|上面|此前|所有|之前所有)?(?:的)?(?:要求|指令|指示|提示|消息|对话)|输出(?:你的|一下|所有)?(?:系统)?(?:提示词|指令|prompt|系统提示)|(?:system|prompt|指令)(?:泄露|显示|leak|reveal)|现在你是(?:一个)?(?:没有|不受|无需).{0,6}(?:限制|规则)的"),
    ("重识别风险", r"独(?:生女|生女|子|女)|唯一(?:继承人|子女|女儿|儿子|知情人|见证人)|某上市公司(?:董事长|创始人|高管|实控人)|毕业于某(?:高校|大学)|某(?:知名|大型)企业(?:创始人|董事长)"),
)
# Words of statements that a lone name is not.
_NO_NAMES = (
    "消费 转账 摘要 金额 余额 收入 支出 合计 人民币 电子汇入 网银转账 跨行 清算 结息 利息 手续费 管理费 交易日期 账户 序号 附言 户名 日期 账号 客户 对方 "
    "交易 业务 卡号 支行 分行 银行 本币 头寸 机构 商户 查询 打印 明细 账单"
).split()
LONE_NAME = ("孤立姓名候选", rf"(?<![{HAN}\]\[）(])[{HAN}]{{2,4}}(?![{HAN}（(])")
#: Characters shown before and after a residue.
CONTEXT = 12
BRACKETED = r"\[[^\]]*\]?"


def outside(text: Column, change) -> Column:
    """The text with ``change`` applied to what lies outside of brackets, each piece behind a closing bracket as its context."""
    pieces = F.split(F.regexp_replace(text, f"({BRACKETED})", f"{HOLD}$1{HOLD}"), HOLD, -1)
    turned = F.transform(pieces, lambda p, i: F.when(i % 2 == 1, p).when(i == 0, change(p)).otherwise(F.substring(change(F.concat(F.lit("]"), p)), 2, 1 << 30)))
    return F.array_join(turned, "")


def _counts(kind: str, value: Column) -> Column:
    """Whether a family's match is a finding."""
    if kind == "金额残留":
        return ~value.rlike(r"^(?!19|20)\d{12,13}$")
    if kind == "项目名称残留":
        name = F.regexp_replace(value, "(?:项目|小区|大厦|花园|公寓|家园|新村|广场|商城)$", "")
        return ~name.rlike(f"^[{_PROJECT_NEVER_FIRST}]") & ~name.rlike("|".join(_PROJECT_GENERIC))
    if kind == LONE_NAME[0]:
        return surname_led(value) & ~value.isin(*NOT_NAMES, *_NO_NAMES)
    if kind == "角色词人名残留":
        return surname_led(F.regexp_extract(value, rf"([{HAN}]{{2,4}})$", 1)) | value.rlike(r"[：:，, ]")
    return F.lit(True)


def residues(masked: DataFrame, text_col: str = "masked", id_col: str = "doc_id") -> DataFrame:
    """A row for each residue: family, value, its context, and whether it is of a critical kind."""

    def families(text: Column) -> Column:
        return F.concat(*(_family(text, kind, pattern) for kind, pattern in (*FAMILIES, LONE_NAME)))

    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"[{SEP}{HOLD}]", "")
    rows = masked.select(id_col, F.explode_outer(let(text, families)).alias("r")).where("r IS NOT NULL")
    return rows.select(id_col, F.col("r.kind").alias("type"), F.col("r.value").alias("value"), F.col("r.context").alias("context"), _critical(F.col("r.kind")).alias("critical"))


def _critical(kind: Column) -> Column:
    out = F.lit(False)
    for k in CRITICAL_KINDS:
        out = out | F.contains(kind, F.lit(k))
    return out


def _family(text: Column, kind: str, pattern: str) -> Column:
    near = CONTEXT + 1  # parts around a match that hold so many characters: every other one is a match

    def found(parts: Column) -> Column:
        side = lambda a, n: F.array_join(F.slice(parts, a, n), "")

        def one(p: Column, i: Column) -> Column:
            before = side(F.greatest(i + 1 - near, F.lit(1)), F.least(i, F.lit(near)))
            context = F.concat(F.substring(before, F.greatest(F.length(before) - CONTEXT + 1, F.lit(1)), F.lit(CONTEXT)), p, F.substring(side(i + 2, F.lit(near)), 1, CONTEXT))
            return F.when((i % 2 == 1) & _counts(kind, p), F.struct(F.lit(kind).alias("kind"), p.alias("value"), F.replace(context, F.lit("\n"), F.lit(" ")).alias("context")))

        return F.filter(F.transform(parts, one), lambda x: x.isNotNull())

    laid = outside(text, lambda p: F.regexp_replace(p, pattern, f"{SEP}$0{SEP}"))
    return F.when(text.rlike(pattern), let(F.split(laid, SEP, -1), found)).otherwise(F.array().cast("array<struct<kind:string,value:string,context:string>>"))


def tiers(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Critical and low residues of each document, and its checklist as text."""
    line = F.concat(F.when(F.col("critical"), "[!] ").otherwise("[ ] "), "type", F.lit("："), "value", F.lit("（…"), "context", F.lit("…）"))
    return found.groupBy(id_col).agg(
        F.count_if("critical").alias("n_critical"),
        F.count_if(~F.col("critical")).alias("n_low"),
        F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("checklist"),
    )


def report(masked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Id and ``review``, the text to go through: replacements by type, residues by tier, whether restoring is lossless, the masked text."""
    kinds = F.array_sort(F.array_distinct(F.transform("mapping", lambda m: m["type"])))
    stats = F.transform(kinds, lambda k: F.concat(F.lit("- "), k, F.lit(": "), F.size(F.filter("mapping", lambda m: m["type"] == k)).cast("string")))
    whole = restored(F.col("masked"), F.col("mapping")) == F.col("normal")
    rows = masked.select(id_col, F.array_join(stats, "\n").alias("_stats"), F.when(whole, "还原往返校验：一致").otherwise("还原往返校验：不一致").alias("_whole"), F.col("masked").alias("_masked"))
    told = rows.join(tiers(residues(masked, id_col=id_col), id_col), id_col, "left")
    count = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    parts = F.concat_ws(
        "\n", F.lit("【替换统计】"), "_stats", F.concat(F.lit("【重点复核】"), count("n_critical"), F.lit(" 【建议复核】"), count("n_low")), F.coalesce("checklist", F.lit("")), "_whole", F.lit("【脱敏后全文】"), "_masked"
    )
    return told.select(id_col, parts.alias("review"))


def surviving(masked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Originals of the mapping that are still readable in the masked text, whole or in part."""
    rows = masked.select(id_col, "masked", F.explode_outer("mapping").alias("m")).where("m IS NOT NULL")
    return rows.where(leaks(F.col("masked"), F.col("m.original"))).select(id_col, "m.original", "m.type")


def reply_faults(before: Column, reply: Column, mapping: Column) -> Column:
    """Why a model's rewriting of a masked text must be refused: lines drifted, placeholders changed, originals back."""
    holders = lambda t: F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\[[^\[\]]+\])"), F.lit(1)))
    return F.filter(
        F.array(
            F.when(F.size(F.split(before, "\n", -1)) != F.size(F.split(reply, "\n", -1)), "lines"),
            F.when(F.size(F.array_except(holders(before), holders(reply))) > 0, "placeholders"),
            F.when(F.exists(mapping, lambda m: F.contains(reply, m["original"])), "originals"),
        ),
        lambda x: x.isNotNull(),
    )
