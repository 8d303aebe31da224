"""Masking of single sentences: what must come out, and what must be left alone."""

import pytest
from pyspark.sql import functions as F

from maskwright.operators import masking, restore, review
from maskwright.operators.masking import Options

CASES = [
    ("执业许可证号：31110000E000123456", "执业许可证号：[律师执业证号]"),
    ("统一社会信用代码：91110108MA01ABC123；另一个 91330105MA27XABC1D", "统一社会信用代码：[统一社会信用代码]；另一个 [统一社会信用代码]"),
    ("身份证号110101198001011234", "身份证号[身份证号]"),
    ("账户622202020001234567", "账户[银行账号]"),
    ("身份证号码3424251967112040X", "身份证号码[身份证号]"),
    ("签订日期：2024年1月15日，男，1985年8月15日出生", "签订日期：2024年1月15日，男，[出生日期]出生"),
    ("A 13800138000 B 13800138000 C 13912345678", "A [手机号] B [手机号] C [手机号]"),
    ("13800138000@qq.com", "[邮箱]"),
    ("案号：(2024)京0108民初12345号", "案号：[案号]"),
    ("我开保时捷粤B88888去", "我开保时捷[车牌号]去"),
    ("护照：E12345678", "护照：[护照号]"),
    ("驾驶证号330106198001011234", "驾驶证号[驾驶证号]"),
    ("收款账号：6222020200012345678", "收款账号：[银行账号]"),
    ("尾款80万元应于三日内支付", "尾款[金额]应于三日内支付"),
    ("设备60万像素，持股8万股", "设备60万像素，持股8万股"),
    ("20181009 20181015 392485911.675", "20181009 20181015 [金额]"),
    ("该分行表示同意", "该分行表示同意"),
    ("6212261001014270893/胡若薇", "[银行账号]/[当事人_1]"),
    ("7399/支***刘方立", "[支付宝账号][当事人_1]"),
    ("原告：陈建国。被告：杭州鼎盛房地产开发有限公司。陈建国再次出现。", "原告：[当事人甲（原告）]。被告：[合同乙方]。[当事人甲（原告）]再次出现。"),
    ("原告上海宝冶集团有限公司（以下简称宝冶公司）与被告广州合生东宇房地产有限公司（以下简称合生东宇公司）签订合同，合生东宇公司付款。", "原告[合同甲方]（以下简称[合同甲方]）与被告[合同乙方]（以下简称[合同乙方]）签订合同，[合同乙方]付款。"),
    ("原告彭静娴诉被告张旭到庭参加诉讼，被告张旭未有提供证据。", "原告[当事人甲（原告）]诉被告[当事人乙（被告）]到庭参加诉讼，被告[当事人乙（被告）]未有提供证据。"),
    ("原告提供担保，法定代表人处签名，法定代表人印章，被告私章，原告主张驳回", "原告提供担保，法定代表人处签名，法定代表人印章，被告私章，原告主张驳回"),
    ("支付宝-刘方立\n支付宝-刘方立\n银联-陈建国", "支付宝-[当事人_1]\n支付宝-[当事人_1]\n银联-[当事人_2]"),
    ("微信号：lawyer_wang，QQ：12345678", "微信号：[微信号]，QQ：[QQ号]"),
    ("户籍地浙江省杭州市余杭区文一西路100号3单元301室", "户籍地[地址]"),
    ("案涉怡丰城项目与工程项目", "案涉[项目名称]与工程项目"),
    ("违约金人民币伍佰万元整，另借3.6万利息", "违约金[金额]，另借[金额]利息"),
    ("客服 400-123-4567", "客服 [服务电话]"),
    ("１３８００１３８０００", "[手机号]"),
    ("", ""),
    (None, ""),
    ("手机 13800138000", "手机 [手机号]"),
]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id int, text string")
    return {r.doc_id: r for r in restore.restore(masking.mask(df)).select("doc_id", "normal", "masked", "mapping", "restored").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_masked(rows, i):
    assert rows[i].masked == CASES[i][1]


def test_restoring_gives_the_preprocessed_text(rows):
    assert all(r.restored == r.normal for r in rows.values())


def test_one_mapping_row_for_each_replacement(rows):
    assert [m.original for m in rows[6].mapping] == ["13800138000", "13800138000", "13912345678"]
    assert [m.ord for m in rows[6].mapping] == [1, 2, 3]


def test_modes(spark):
    df = spark.createDataFrame([(1, "签订于2024年1月15日，付5000000。")], "doc_id int, text string")
    assert masking.mask(df, options=Options(all_dates=True)).first().masked == "签订于[日期]，付[金额]。"
    assert masking.mask(df, options=Options(amounts=False)).first().masked == "签订于2024年1月15日，付5000000。"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id int, text string, mapping_note string")
    assert masking.stats_by_type(masking.mask(df)).count() == 0


def test_no_shuffle_and_no_python(spark):
    plan = masking.mask(spark.createDataFrame([(1, "x")], "doc_id int, text string")).select("masked")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_long_text_without_matches(spark):
    df = spark.createDataFrame([(1, "a" * 300_000 + " 13800138000 " + "中" * 100_000)], "doc_id int, text string")
    assert masking.mask(df).select(F.size("mapping")).first()[0] == 1


def test_joined_restore_keeps_placeholders_without_partner(spark):
    masked = spark.createDataFrame([(1, "甲[金额]乙[金额]"), (2, "无")], "doc_id int, masked string")
    known = spark.createDataFrame([(1, 1, "5元", "[金额]")], "doc_id int, ord int, original string, replacement string")
    assert {r.doc_id: r.restored for r in restore.restore_joined(masked, known).collect()} == {1: "甲5元乙[金额]", 2: "无"}


def test_reply_faults(spark):
    known = F.array(F.struct(F.lit("张三").alias("original")))
    faults = spark.range(1).select(review.reply_faults(F.lit("a[甲]\nb"), F.lit("a 张三"), known)).first()[0]
    assert faults == ["lines", "placeholders", "originals"]


def test_discovered_names(spark):
    from maskwright.operators import discovery

    rows = [(1, "张三欠李四钱不还"), (2, "欧阳雪梅称已还款。欧阳雪梅"), (3, "余款未付，范围不明"), (4, None), (5, "2024-05-01 转账 王秀英\n合计 转账 李秀英"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    factory = discovery.dictionary_segmenter(["欠", "钱", "不还", "称", "已", "还款", "余款", "未付", "范围", "不明", "转账", "合计"])
    found = {r.doc_id: sorted(r.found_names or []) for r in discovery.discover(df, factory).collect()}
    assert found == {1: ["张三", "李四"], 2: ["欧阳雪梅"], 3: [], 4: [], 5: ["王秀英"], 6: []}
    assert {r.doc_id: sorted(r.found_names or []) for r in discovery.discover(df).collect()} == {1: [], 2: [], 3: [], 4: [], 5: ["王秀英"], 6: []}


def test_brackets_of_any_length_are_left_alone(spark):
    from maskwright.operators import review, second_pass

    inside = "杭州法院" + "文" * 500
    df = spark.createDataFrame([(1, f"[{inside}] 临平法院")], "doc_id long, text string")
    masked = masking.mask(df)
    assert [r.value for r in review.residues(masked).where("type = '法院名称'").collect()] == ["临平法院"]
    out = second_pass.user_rules(masked, [("法院", "..法院", "[审理法院]")]).first()
    assert out.masked2 == f"[{inside}] [审理法院]"


def test_columns_that_clash_are_replaced(spark):
    df = spark.createDataFrame([(1, "联系 13800138000 。", "a", "b", "c", "d")], "doc_id long, text string, masked string, mapping string, names string, normal string")
    out = masking.mask(df)
    assert sorted(out.columns) == ["doc_id", "mapping", "masked", "names", "normal", "text"] and out.first().masked == "联系 [手机号] 。"
