"""The catalogue of masking rules, as data, in the order in which they run.

Order is part of the semantics: what an earlier rule has taken a later one doesn't see. Patterns that
begin with an unbounded run say where a run may be entered (at its start, or where the last match
ended), which changes no match but keeps endless runs linear.
"""

from __future__ import annotations

from dataclasses import dataclass

HAN = "一-龥"
SP = "[ \t]*"


def spaced(word: str) -> str:
    """The word with white space of a line allowed between its characters, as text recognition leaves it."""
    return SP.join("\\" + c if c in ".*+?()[]{}|^$\\" else c for c in word)


def any_of(words, spaces: bool = False) -> str:
    return "(?:" + "|".join(spaced(w) if spaces else w for w in words) + ")"


@dataclass(frozen=True)
class Rule:
    """kind: the type in results; label_first: group 1 is a label that stays; gate: a named condition;
    reuse: a value seen before keeps its first placeholder; part: amounts and dates, which modes leave out;
    any_script: the rule can match in a text without a single Han character; long: its matches have no bound;
    needs: characters one of which every match or its label holds, so that a text without them isn't searched."""

    kind: str
    pattern: str
    placeholder: str = ""
    label_first: bool = False
    gate: str = ""
    reuse: bool = False
    part: str = ""
    any_script: bool = False
    long: bool = False
    needs: str = ""

    def shown(self) -> str:
        return self.placeholder or f"[{self.kind}]"


# Labels, lengths and forms of the structured rules.
_COLON = r"\s*[：:]?\s*"
_CERTIFICATES = (
    ("护照号", "护照|护照号", "[A-Za-z0-9]{6,12}", "照"),
    ("港澳通行证", "港澳通行证|往来港澳通行证|港澳居民来往内地通行证", "[A-Za-z0-9]{5,12}", "通"),
    ("台胞证", "台湾居民来往大陆通行证|台胞证", "[A-Za-z0-9]{5,12}", "台"),
    ("驾驶证号", "驾驶证|驾驶证号|驾驶证号码", "[0-9A-Za-z]{6,20}", "驾"),
    ("军官证", "军官证|士兵证|警官证|工作证", "[0-9A-Za-z]{4,20}", "证"),
    ("营业执照号", "营业执照|营业执照号|营业执照号码", "[0-9A-Za-z]{8,20}", "照"),
    ("税务登记号", "税务登记证号|税务登记号", "[0-9A-Za-z]{8,20}", "税"),
    ("罚没许可证号", "罚没许可证号|罚没许可证|罚没许可", "[0-9]{6,12}", "罚"),
)
_WECHAT = rf"({spaced('微信号码')}|{spaced('微信')}(?:账号|号)?)".replace("(", "(?:", 1)
_DATE = r"\d{4}年\d{1,2}月\d{1,2}日"
_NOT_DATE_HAN = rf"(?:(?![日月年号])[{HAN}])"
_TAIL = rf"[{HAN}\d\-（\(\)） ]"
_PROVINCE = rf"{_NOT_DATE_HAN}{{1,3}}(?:省|自治区)[{HAN} ]{{1,10}}(?:市|县|区|镇)[{HAN} ]{{1,10}}(?:区|县|市|镇){_TAIL}{{5,40}}(?:号|室|层)"
_CAPITALS = "零壹贰叁肆伍陆柒捌玖拾"

ADDRESSES = (
    rf"((?:户籍所在地|户籍地|户籍|住所地|住所|住址|居住地|居住|现住|家住|住|地址|位于)[：:]?\s*)({_PROVINCE})",
    rf"(?<![{HAN}])(?:{_PROVINCE})",
    rf"{_NOT_DATE_HAN}{{2,8}}(?:市|区|县|镇)[{HAN}]*(?:路|街|大道|巷){_TAIL}{{2,29}}(?:号|室|层|栋|幢)(?:\d+)?",
    rf"{_NOT_DATE_HAN}{{2,12}}(?:小区|花园|家园|公寓|大厦|新村|苑|里|坊|巷|弄|胡同|街道|社区|村|镇|区|片)[{HAN}\d\- ]{{0,12}}(?:号|栋|幢|单元|室|楼|座|层|片|里)",
    rf"{_NOT_DATE_HAN}{{2,12}}(?:路|街|大道|巷|弄|胡同)[{HAN}\d\- ]{{1,12}}(?:号|弄|栋|幢|单元|室|楼|座)",
)

BEFORE_NAMES: tuple[Rule, ...] = (
    Rule("律师执业证号", rf"((?:执业证号|执业许可证号|律师执业证号|律师执业证|执业证){_COLON})([0-9A-Z]{{17,18}})", label_first=True, needs="执"),
    *(Rule(kind, rf"((?:{labels}){_COLON})({form})", label_first=True, needs=needs) for kind, labels, form, needs in _CERTIFICATES),
    Rule("身份证号", rf"((?:身份证号|身份证号码|身份证|证件号码|证件号){_COLON})(\d{{15,17}}[\dXx]?)", label_first=True, needs="证"),
    Rule("身份证号", r"(?<!\d)\d{17}[\dXx](?!\d)", gate="id", reuse=True, any_script=True),
    Rule("邮箱", r"(?:(?<![A-Za-z0-9.+-])|\G)[A-Za-z0-9.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", reuse=True, any_script=True, long=True, needs="@"),
    Rule("手机号", r"(?<!\d)1[3-9]\d{9}(?!\d)", reuse=True, any_script=True),
    Rule("固定电话", r"(?<!\d)0\d{2,3}[-\s]?\d{7,8}(?!\d)", reuse=True, any_script=True),
    Rule("固定电话", r"(?<!\d)[48]00[-\s]?\d{3}[-\s]?\d{4}(?!\d)", "[服务电话]", reuse=True, any_script=True),
    Rule("微信号", rf"({_WECHAT}\s*[：:为是=]?\s*)([a-zA-Z][a-zA-Z0-9_]{{4,19}}|(?:\+?86)?1[3-9]\d(?:[-\s]?\d{{4}}){{2}})", label_first=True, needs="微"),
    Rule("微信号", rf"(?<![{HAN}a-zA-Z0-9_@/.])(?=[a-zA-Z]*[0-9_])[a-zA-Z][a-zA-Z0-9_]{{5,19}}(?![a-zA-Z0-9_@]|\.com|\.cn)", gate="han_text", any_script=True),
    Rule("QQ号", rf"((?:QQ|Qq|qq){_COLON})(\d{{5,12}})(?!\d)", label_first=True, any_script=True, needs="Qq"),
    Rule("组织机构代码", r"(?<![0-9A-Z-])[0-9A-Z]{8}-[0-9A-Z](?![0-9A-Z-])", reuse=True, any_script=True, needs="-"),
    Rule("统一社会信用代码", rf"((?:统一社会信用代码|社会信用代码|信用代码){_COLON})([0-9A-Z]{{18}})", label_first=True, needs="信"),
    Rule("银行账号", r"(?<!\d)\d{14,20}(?!\d)", reuse=True, any_script=True),
    Rule("银行账号", rf"((?:银行账号|开户账号|账户号码|银行卡号|收款账号|付款账号|卡号){_COLON})([0-9]{{12,24}})", label_first=True, needs="号"),
    Rule("统一社会信用代码", r"(?<![0-9A-Z])9[0-9A-Z]{17}(?![0-9A-Z])", reuse=True, any_script=True),
    Rule("案号", rf"(?:(?<![ \t])|\G)[（(]?[ \t]*\d{{4}}[ \t]*[）)]?[ \t]*(?![年月日])[{HAN}]{{1,10}}[ \t]*\d{{0,6}}[ \t]*[{HAN}]{{0,6}}[ \t]*\d{{1,6}}[ \t]*号", reuse=True, needs="号"),
    Rule("地块编号", rf"[{HAN}]{{1,4}}储出[ \t]*[（(][ \t]*\d{{4}}[ \t]*[）)][ \t]*\d+[ \t]*号?[ \t]*地块?", reuse=True, needs="储"),
    Rule("车牌号", rf"(?<![A-Za-z0-9])[{HAN}][A-Z][A-Z0-9]{{5,6}}(?![\dA-Za-z])", reuse=True),
    Rule("出生日期", rf"((?:出生日期|出生年月|生日|出生于|生于){_COLON})({_DATE})", label_first=True, part="birth", needs="生"),
    Rule("出生日期", rf"{_DATE}(?=\s*(?:出生|生))", part="birth", needs="生"),
    Rule("日期", rf"(?<!\d){_DATE}(?!\d)", reuse=True, part="dates", needs="年"),
)

#: The rules of names (people, accounts with names, companies) run here; see ``operators.entities``.

AFTER_NAMES: tuple[Rule, ...] = (
    Rule("银行机构", rf"[{HAN}]{{2,12}}(?:分行|支行)(?:本级|本币|头寸|机构)*", reuse=True, long=True, needs="行"),
    Rule("项目名称", "", gate="project", needs="目区园寓村厦场城期段"),
    Rule("地址", ADDRESSES[0], label_first=True, needs="省治"),
    *(Rule("地址", p, long=True, needs=needs) for p, needs in zip(ADDRESSES[1:], ("省治", "路街道巷", "号栋幢元室楼座层片里", "路街道巷弄同"), strict=True)),
    Rule("金额", rf"(?<![\d{_CAPITALS}])(?:人民币|美金|港币)?[{_CAPITALS}](?:[{_CAPITALS}]|佰|仟|万|亿|元|圆|整)[{_CAPITALS}佰仟万亿元整]*(?:元|圆)?(?:整)?", reuse=True, part="amount", long=True, needs="零壹贰叁肆伍陆柒捌玖拾"),
    Rule("金额", r"(?:(?<!\d)|(?=\d{1,3},))[$¥]?(?:\d{1,3}(?:,\d{3})*|\d+)(?:\.\d{1,2})?[ \t]*[万千亿]?[ \t]*(?:元|美元|欧元|英镑|港币)[ \t]*整?(?![.\d万千亿])", reuse=True, part="amount", long=True, needs="元镑币"),
    Rule("金额", r"(?<!\d)\d+(?:\.\d+)?[万千亿](?![.\d万千亿])(?!像素|股|人|户|平方米|平米|瓦|公里|粉丝|预算|年薪|月薪|彩礼)", reuse=True, part="amount", long=True, needs="万千亿"),
    Rule("金额", r"(?<!\d)(?!(?:19|20)\d{6})\d{7,}(?:\.\d{1,3})?(?!\d)", reuse=True, part="amount", any_script=True, long=True),
)

# Kinds whose survival is critical in a review.
CRITICAL_KINDS = ("身份证号", "手机号", "银行账号", "案号", "统一社会信用代码", "律师执业证号", "罚没许可证号", "固定电话", "邮箱", "微信号", "QQ号")
