"""Made-up values and labelled sentences from keys: the same key and seed give the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import CREDIT_ALPHABET, CREDIT_WEIGHTS, ID_CHECK, ID_WEIGHTS, _weighted

SURNAMES, GIVEN = "王李张刘陈杨黄赵吴周", "建军丽伟芳娜敏静磊强"
CITIES = ("杭州", "上海", "北京", "广州", "成都")


def draw(key: Column, n: int, salt: int, seed: int = 42) -> Column:
    """A number below ``n``."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), key), F.lit(n))


def digits(key: Column, k: int, salt: int, seed: int = 42) -> Column:
    return F.lpad(draw(key, 10**k, salt, seed).cast("string"), k, "0")


def _pick(text: str, key: Column, salt: int, seed: int) -> Column:
    return F.substring(F.lit(text), (draw(key, len(text), salt, seed) + 1).cast("int"), F.lit(1))


def person(key: Column, seed: int = 42) -> Column:
    return F.concat(_pick(SURNAMES, key, 1, seed), _pick(GIVEN, key, 2, seed), _pick(GIVEN, key, 3, seed))


def company(key: Column, seed: int = 42) -> Column:
    return F.concat(city(key, seed), _pick("鼎盛华云恒信瑞", key, 5, seed), _pick("达泰丰通源", key, 6, seed), F.lit("科技有限公司"))


def city(key: Column, seed: int = 42) -> Column:
    return F.element_at(F.array(*map(F.lit, CITIES)), (draw(key, len(CITIES), 4, seed) + 1).cast("int"))


def mobile(key: Column, seed: int = 42) -> Column:
    return F.concat(F.lit("1"), _pick("3456789", key, 7, seed), digits(key, 9, 8, seed))


def email(key: Column, seed: int = 42) -> Column:
    return F.concat(F.lit("u"), digits(key, 6, 9, seed), F.lit("@example.com"))


def id_number(key: Column, seed: int = 42) -> Column:
    """With a birth date and a check character that hold."""
    day = F.date_format(F.date_add(F.lit("1950-01-01").cast("date"), draw(key, 20000, 10, seed).cast("int")), "yyyyMMdd")
    body = F.concat(F.lit("110101"), day, digits(key, 3, 11, seed))
    return F.concat(body, F.substring(F.lit(ID_CHECK), (_weighted(body, ID_WEIGHTS, lambda c: F.ascii(c) - 48) % 11 + 1).cast("int"), F.lit(1)))


def credit_code(key: Column, seed: int = 42) -> Column:
    body = F.concat(F.lit("91330105MA"), digits(key, 7, 12, seed))
    total = _weighted(body, CREDIT_WEIGHTS, lambda c: F.instr(F.lit(CREDIT_ALPHABET), c) - 1)
    return F.concat(body, F.substring(F.lit(CREDIT_ALPHABET), ((F.lit(31) - total % 31) % 31 + 1).cast("int"), F.lit(1)))


def card(key: Column, seed: int = 42) -> Column:
    """Sixteen digits that pass Luhn: of the ten last digits, the one that does."""
    body = F.concat(F.lit("6222"), digits(key, 11, 13, seed))
    return F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(body, d.cast("string"))), lambda v: F.call_function("luhn_check", v)), 0)


def case_number(key: Column, seed: int = 42) -> Column:
    return F.concat(F.lit("(2024)京0108民初"), (draw(key, 99999, 14, seed) + 1).cast("string"), F.lit("号"))


def plate(key: Column, seed: int = 42) -> Column:
    return F.concat(_pick("粤京沪浙苏", key, 15, seed), _pick("ABCDEF", key, 16, seed), digits(key, 5, 17, seed))


def amount(key: Column, seed: int = 42) -> Column:
    return F.concat((draw(key, 10**6, 18, seed) + 1).cast("string"), F.lit("元"))


def address(key: Column, seed: int = 42) -> Column:
    return F.concat(F.lit("浙江省杭州市余杭区文一西路"), (draw(key, 999, 19, seed) + 1).cast("string"), F.lit("号"))


def date(key: Column, seed: int = 42) -> Column:
    return F.concat((draw(key, 30, 20, seed) + 1990).cast("string"), F.lit("年"), (draw(key, 12, 21, seed) + 1).cast("string"), F.lit("月"), (draw(key, 28, 22, seed) + 1).cast("string"), F.lit("日"))


#: Han characters that a template has at least.
LEAST_HAN = 10
#: slot of a template -> type of the value and its generator.
SLOTS = {
    "person": ("人名", person), "company": ("公司名", company), "mobile": ("手机号", mobile), "email": ("邮箱", email), "id": ("身份证号", id_number), "credit": ("统一社会信用代码", credit_code),
    "card": ("银行账号", card), "case": ("案号", case_number), "plate": ("车牌号", plate), "amount": ("金额", amount), "address": ("地址", address), "birth": ("出生日期", date),
}
TEMPLATES = (
    "原告：{person}，身份证号：{id}，手机 {mobile}。",
    "被告{company}，信用代码：{credit}，尾款{amount}。",
    "案号：{case}，车牌 {plate}，邮箱 {email} 。",
    "收款账号：{card}，住址：{address}，生日：{birth}，完。",
    "申请执行人：{person}，联系电话 {mobile}，付款账号：{card}，完。",
    "证人：{person}，住址：{address}，身份证号：{id}。",
    "第三人{company}，信用代码：{credit}，邮箱 {email} 。",
    "法定代表人：{person}，案号：{case}，尾款{amount}。",
    "车牌 {plate}，登记电话 {mobile}，生日：{birth}，完。",
    "被执行人：{person}，卡号：{card}，欠款{amount}。",
    "案外人：{person}，邮箱 {email} ，住址：{address}，完。",
)


def bad_slots(template: str) -> list[str]:
    """Slots that no generator fills."""
    import re

    return sorted(set(re.findall(r"\{(\w+)\}", template)) - set(SLOTS))


def labelled_cases(keys: DataFrame, key_col: str = "id", templates: tuple[str, ...] = TEMPLATES, seed: int = 42) -> DataFrame:
    """id, text, expect_masked and entities (with spans) of a sentence for each key, templates in turn."""
    import re

    if unknown := sorted({s for t in templates for s in bad_slots(t)}):
        raise ValueError(f"no generator for {unknown}")
    k = F.col(key_col)
    made = []
    for t in templates:
        parts = re.split(r"\{(\w+)\}", t)
        values = [F.struct(F.lit(SLOTS[s][0]).alias("type"), SLOTS[s][1](k, seed).alias("value")) for s in parts[1::2]]
        text = F.concat(*(F.lit(p) if i % 2 == 0 else values[i // 2]["value"] for i, p in enumerate(parts)))
        made.append(F.struct(text.alias("text"), F.array(*values).alias("expect_masked")))
    case = F.element_at(F.array(*made), (F.pmod(k, F.lit(len(made))) + 1).cast("int"))
    rows = keys.select(k.alias("id"), case.alias("c")).select("id", "c.*")
    spans = F.transform("expect_masked", lambda e: F.struct(e["value"], e["type"].alias("label"), (F.instr(F.col("text"), e["value"]) - 1).alias("start"), (F.instr(F.col("text"), e["value"]) - 1 + F.length(e["value"])).alias("end")))
    return rows.withColumn("entities", spans)


def bio(cases: DataFrame) -> DataFrame:
    """Adds tokens, a character each, and their BIO labels."""
    tokens = F.split("text", "")
    label = F.transform(
        tokens,
        lambda t, i: F.coalesce(
            F.get(F.transform(F.filter("entities", lambda e: (e["start"] <= i) & (i < e["end"])), lambda e: F.concat(F.when(e["start"] == i, "B-").otherwise("I-"), e["label"])), 0), F.lit("O")
        ),
    )
    return cases.withColumn("tokens", tokens).withColumn("bio_labels", label)
