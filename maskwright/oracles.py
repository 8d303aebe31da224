"""DuckDB SQL for the engine's queries, written from what must come out, not from the rules' patterns."""

from __future__ import annotations

_K = "c_custkey AS k FROM customer"
_MOBILE = "('13' || lpad(CAST(k AS VARCHAR), 9, '0'))"


def _person(k: str = "k") -> str:
    return f"(substr('王李张刘陈杨黄赵吴周', CAST(({k}) % 10 + 1 AS INTEGER), 1) || substr('建军丽伟芳娜敏静磊强', CAST(({k}) // 10 % 10 + 1 AS INTEGER), 1))"


# Values in documents: e-mail addresses first, then maximal runs of digits by length.
_DOC_VALUES = r"""
WITH e AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+') AS mails,
    regexp_replace(coalesce(text, ''), '[A-Za-z0-9.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+', '‹', 'g') AS t FROM documents),
d AS (SELECT doc_id, unnest(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+)*')) AS chain FROM e),
r AS (SELECT doc_id, unnest(string_split(chain, '.')) AS run FROM d),
v AS (SELECT doc_id, '邮箱' AS type, unnest(mails) AS original, '[邮箱]' AS replacement FROM e
  UNION ALL SELECT doc_id, '银行账号', run, '[银行账号]' FROM r WHERE length(run) BETWEEN 14 AND 20
  UNION ALL SELECT doc_id, '手机号', run, '[手机号]' FROM r WHERE regexp_full_match(run, '1[3-9][0-9]{9}')
  UNION ALL SELECT doc_id, '固定电话', run, '[固定电话]' FROM r WHERE regexp_full_match(run, '0[0-9]{9,11}')
  UNION ALL SELECT doc_id, '固定电话', run, '[服务电话]' FROM r WHERE regexp_full_match(run, '[48]00[0-9]{7}')
  UNION ALL SELECT doc_id, '金额', run, '[金额]' FROM r WHERE length(run) >= 7 AND NOT length(run) BETWEEN 14 AND 20
    AND NOT regexp_matches(run, '^(?:19|20)[0-9]{6}') AND NOT regexp_full_match(run, '1[3-9][0-9]{9}|0[0-9]{9,11}|[48]00[0-9]{7}'))
"""

#: kind -> (before, value by key, after, whether the value is masked)
_SENTENCES = {
    "手机号": ("联系 ", "[手机号]", " 。"), "邮箱": ("写信 ", "[邮箱]", " 。"), "身份证号": ("身份证号：", "[身份证号]", "，"), "护照号": ("护照：", "[护照号]", "，"),
    "银行账号": ("收款账号：", "[银行账号]", "，"), "案号": ("案号：", "[案号]", "，"), "车牌号": ("车牌 ", "[车牌号]", " 。"), "QQ号": ("QQ：", "[QQ号]", "，"),
    "微信号": ("微信号：", "[微信号]", "，"), "出生日期": ("生日：", "[出生日期]", "，"), "组织机构代码": ("代码 ", "[组织机构代码]", " 。"),
    "统一社会信用代码": ("信用代码：", "[统一社会信用代码]", "，"), "固定电话": ("电话 ", "[固定电话]", " 。"), "律师执业证号": ("执业证号：", "[律师执业证号]", "，"),
    "地址": ("地址：", "[地址]", "，"), "金额": ("尾款", "[金额]", "，"), "地块编号": ("地块 ", "[地块编号]", "，"),
}
_SENTENCE_ROWS = ", ".join(f"('{kind}', '{a}{p}{z}其余不变', '{p}')" for kind, (a, p, z) in _SENTENCES.items())

#: kind -> the sentence as it must come out
_MORE = {
    "护照号": "护照号 [护照号]，", "港澳通行证": "港澳通行证：[港澳通行证]，", "台胞证": "台胞证：[台胞证]，", "驾驶证号": "驾驶证号[驾驶证号]，", "军官证": "军官证：[军官证]，", "营业执照号": "营业执照：[营业执照号]，",
    "税务登记号": "税务登记号：[税务登记号]，", "罚没许可证号": "罚没许可证：[罚没许可证号]，", "身份证号裸": "号码 [身份证号] 。", "服务电话": "致电 [服务电话] 。", "微信号裸": "加我 [微信号] 细说这件事情", "银行账号裸": "转到 [银行账号] 。",
    "信用代码裸": "代码 [统一社会信用代码] 。", "出生后置": "男，[出生日期]出生，", "银行机构": "[银行机构]，", "项目名称": "涉案[项目名称]，", "地址省": "，[地址]。", "金额大写": "合计[金额]，", "金额口语": "借[金额]，", "金额裸": "汇 [金额] 。", "像素": "",
}
_MORE_ROWS = ", ".join(f"('{kind}', '{text}其余不变')" for kind, text in _MORE.items())

_HTML_STEPS = (
    ("(?is)<script.*?</script>", ""), ("(?is)<style.*?</style>", ""), (r"(?i)<br\s*/?>", "\n"), ("(?i)</(p|div|h[1-6]|li|tr|pre|blockquote)>", "\n"),
    ("<[^>]+>", ""), ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", '"'), ("(?i)&#39;|&apos;", "''"),
    (r"\n{3,}", "\n\n"), (r"^\s+|\s+$", ""),
)


def _html() -> str:
    out = "coalesce(html, '')"
    for pattern, with_ in _HTML_STEPS:
        out = f"regexp_replace({out}, '{pattern}', '{with_}', 'g')"
    return f"SELECT page_id, {out} AS text FROM pages"


_ID = "'11010119800101' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0')"
_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_CREDIT = "0123456789ABCDEFGHJKLMNPQRTUWXY"
_CREDIT_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)


def _sum(value: str, weights, digit: str) -> str:
    return " + ".join(digit.format(c=f"substr({value}, {i}, 1)") + f" * {w}" for i, w in enumerate(weights, 1))


_CASE_ROWS = f"""
WITH c AS (SELECT {_K}),
x AS (SELECT k, 'masked' AS kind, '手机号' AS type, true AS ok FROM c
  UNION ALL SELECT k, 'masked', 'QQ号', true FROM c
  UNION ALL SELECT k, 'kept', '保留项', true FROM c
  UNION ALL SELECT k, 'kept', '旺旺', true FROM c),
n AS (SELECT coalesce(type, 'MICRO') AS type, count(*) FILTER (WHERE kind = 'masked' AND ok) AS tp, count(*) FILTER (WHERE kind = 'kept' AND NOT ok) AS fp,
  count(*) FILTER (WHERE kind = 'masked' AND NOT ok) AS fn FROM x GROUP BY ROLLUP (type)),
s AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0 END AS recall, tp + fn AS support FROM n),
f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM s)
"""

#: kind -> (characters before the value, whether the finding begins with them, value)
_SCAN_VALUES = {
    "手机号": (3, False, _MOBILE), "邮箱": (3, False, "'user' || k || '@example.com'"), "身份证号": (5, True, f"{_ID} || '1'"), "护照号": (3, True, "'E' || lpad(CAST(k AS VARCHAR), 8, '0')"),
    "银行账号": (5, True, "'6222' || lpad(CAST(k AS VARCHAR), 12, '0')"), "案号": (3, False, "'(2024)京0108民初' || (k % 99999 + 1) || '号'"),
    "车牌号": (3, False, "'粤B' || lpad(CAST(k % 100000 AS VARCHAR), 5, '0')"), "QQ号": (3, True, "lpad(CAST(k AS VARCHAR), 8, '1')"), "微信号": (4, True, "'wx_' || lpad(CAST(k AS VARCHAR), 6, '0')"),
    "出生日期": (3, True, "'1980年' || (k % 12 + 1) || '月' || (k % 28 + 1) || '日'"), "组织机构代码": (3, False, "lpad(CAST(k % 100000000 AS VARCHAR), 8, '6') || '-' || (k % 10)"),
    "统一社会信用代码": (5, True, "'91330105MA27' || lpad(CAST(k % 1000000 AS VARCHAR), 6, 'X')"), "固定电话": (3, False, "'0571-8' || lpad(CAST(k % 10000000 AS VARCHAR), 7, '0')"),
    "律师执业证号": (5, True, "'3111' || lpad(CAST(k AS VARCHAR), 13, '0')"), "地址": (3, True, "'浙江省杭州市余杭区文一西路' || (k % 999 + 1) || '号'"),
    "金额": (2, False, "(k % 9999 + 1) || '元'"), "地块编号": (3, False, "'余政储出(2012)' || (k % 999 + 1) || '号地块'"),
}
_SCAN_ROWS = " UNION ALL ".join(
    f"SELECT '{kind}/' || k AS doc_id, '{kind}' AS type, {value} AS value, CAST({0 if led else n} AS BIGINT) AS start, CAST({n} + length({value}) AS BIGINT) AS end_ FROM c" for kind, (n, led, value) in _SCAN_VALUES.items()
)

ORACLE_SQL = {
    "mask_stats_by_type": _DOC_VALUES + "SELECT type, count(*) AS n, count(DISTINCT original) AS n_values FROM v GROUP BY type",
    "mapping_values": _DOC_VALUES + "SELECT doc_id, type, original, replacement, count(*) AS n FROM v GROUP BY ALL",
    "mask_totals": _DOC_VALUES + "SELECT d.doc_id, count(DISTINCT original) AS n_values, count(original) AS n_replacements FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id",
    "restore_roundtrip": _DOC_VALUES + "SELECT d.doc_id, true AS lossless, count(original) AS n FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id",
    "restore_by_join": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "luhn_values": _DOC_VALUES + """, b AS (SELECT *, list_sum(list_transform(range(length(original)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(original, length(original) - i, 1) AS INTEGER)
      ELSE CAST(substr('0246813579', CAST(substr(original, length(original) - i, 1) AS INTEGER) + 1, 1) AS INTEGER) END)) AS s FROM v WHERE type = '银行账号')
      SELECT doc_id, original, s % 10 = 0 AS validated, count(*) AS n FROM b GROUP BY ALL""",
    "html_text": _html(),
    "flatten_props": "SELECT event_id, json_extract_string(props, '$.k') AS props_k FROM events",
    "id_checksum": f"""WITH c AS (SELECT {_K}), r AS (SELECT k, {_ID} AS v, unnest(string_split('0 1 2 3 4 5 6 7 8 9 X', ' ')) AS last FROM c)
      SELECT k, last, substr('10X98765432', CAST(({_sum('v', _WEIGHTS, 'CAST({c} AS INTEGER)')}) % 11 + 1 AS INTEGER), 1) = last AS valid, true AS dated FROM r""",
    "credit_checksum": f"""WITH c AS (SELECT {_K}), r AS (SELECT k, '9133' || lpad(CAST(k AS VARCHAR), 13, '0') AS v, unnest(string_split('{' '.join(_CREDIT)}', ' ')) AS last FROM c)
      SELECT k, last, substr('{_CREDIT}', CAST((31 - ({_sum('v', _CREDIT_WEIGHTS, f"(instr('{_CREDIT}', {{c}}) - 1)")}) % 31) % 31 + 1 AS INTEGER), 1) = last AS valid FROM r""",
    "structured_rules": f"SELECT k, kind, masked FROM (SELECT {_K}), (VALUES {_SENTENCE_ROWS}) AS s(kind, masked, placeholder)",
    "structured_types": f"SELECT kind, kind AS type, placeholder AS replacement, (SELECT count(*) FROM customer) AS n FROM (VALUES {_SENTENCE_ROWS}) AS s(kind, masked, placeholder)",
    "all_dates": f"SELECT k, '签订日期：2024年' || (k % 12 + 1) || '月1日，金额未定' AS kept, '签订日期：[日期]，金额未定' AS masked FROM (SELECT {_K})",
    "person_placeholders": f"SELECT k, '原告：[当事人甲（原告）]。被告：[当事人乙（被告）]。支付宝-[当事人_3] 转入。[当事人甲（原告）]收款后未还。被告杭州鼎盛' || k || '号货已交。' AS masked FROM (SELECT {_K})",
    "entity_table": f"""WITH c AS (SELECT {_K}) SELECT k, 'person_1' AS entity_id, '[当事人甲（原告）]' AS placeholder, 'plaintiff' AS role, 'plaintiff' AS roles_seen, 2 AS mentions, false AS conflict FROM c
      UNION ALL SELECT k, 'person_2', '[当事人乙（被告）]', 'defendant', 'defendant', 1, false FROM c UNION ALL SELECT k, 'person_3', '[当事人_3]', '交易对手', '交易对手', 1, false FROM c""",
    "role_conflicts": f"SELECT k, '[当事人甲（原告）]' AS placeholder, CASE WHEN k % 3 = 0 THEN 'plaintiff,witness' ELSE 'plaintiff' END AS roles_seen, k % 3 = 0 AS conflict FROM (SELECT {_K})",
    "company_links": f"SELECT k, '原告[合同甲方]（以下简称[合同甲方]）与被告[合同乙方]签订合同，[合同甲方]付款。' AS masked FROM (SELECT {_K})",
    "slash_accounts": f"SELECT k, '对方 [银行账号]/[当事人_1] [银行账号]/[当事人_2] [支付宝账号][当事人_3] 完' AS masked FROM (SELECT {_K})",
    "preprocessed": f"SELECT k, 'AB ' || k || '元' AS text FROM (SELECT {_K})",
    "scan_findings": f"""WITH c AS (SELECT {_K}), r AS ({_SCAN_ROWS}),
      j AS (SELECT *, CASE type WHEN '身份证号' THEN substr('10X98765432', CAST(({_sum("value", _WEIGHTS, "CAST({c} AS INTEGER)")}) % 11 + 1 AS INTEGER), 1) = substr(value, 18, 1) END AS id_ok FROM r WHERE type = '身份证号'),
      u AS (SELECT *, substr('{_CREDIT}', CAST((31 - ({_sum("value", _CREDIT_WEIGHTS, f"(instr('{_CREDIT}', {{c}}) - 1)")}) % 31) % 31 + 1 AS INTEGER), 1) = substr(value, 18, 1) AS credit_ok FROM r WHERE type = '统一社会信用代码'),
      l AS (SELECT *, list_sum(list_transform(range(16), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(value, 16 - i, 1) AS INTEGER)
        ELSE CAST(substr('0246813579', CAST(substr(value, 16 - i, 1) AS INTEGER) + 1, 1) AS INTEGER) END)) % 10 = 0 AS luhn FROM r WHERE type = '银行账号')
      SELECT doc_id, type, value, start, end_ AS "end", 1.0::DOUBLE AS confidence, false AS validated FROM r WHERE type NOT IN ('身份证号', '统一社会信用代码', '银行账号')
      UNION ALL SELECT doc_id, type, value, start, end_, CASE WHEN id_ok THEN 1.0 ELSE 0.6 END, id_ok FROM j
      UNION ALL SELECT doc_id, type, value, start, end_, CASE WHEN credit_ok THEN 1.0 ELSE 0.5 END, credit_ok FROM u
      UNION ALL SELECT doc_id, type, value, start, end_, CASE WHEN luhn THEN 1.0 ELSE 0.6 END, luhn FROM l""",
    "scan_documents": r"""WITH m AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS value FROM documents),
      b AS (SELECT unnest(list_filter(regexp_extract_all(text, '[0-9]+'), lambda x: length(x) BETWEEN 14 AND 20)) AS value FROM documents)
      SELECT '邮箱' AS type, count(*) AS n, count(DISTINCT value) AS n_values FROM m
      UNION ALL SELECT '银行账号', count(*), count(DISTINCT value) FROM b WHERE list_sum(list_transform(range(length(value)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(value, length(value) - i, 1) AS INTEGER)
        ELSE CAST(substr('0246813579', CAST(substr(value, length(value) - i, 1) AS INTEGER) + 1, 1) AS INTEGER) END)) % 10 = 0 HAVING count(*) > 0""",
    "review_residues": f"""WITH c AS (SELECT {_K}) SELECT k AS doc_id, '法院名称' AS type, false AS critical, 1 AS n FROM c UNION ALL SELECT k, '重识别风险', false, 1 FROM c
      UNION ALL SELECT k, '身份证号/手机号/银行账号', true, 1 FROM c WHERE k % 2 = 0 UNION ALL SELECT k, '金额残留', false, 1 FROM c WHERE k % 2 = 0 UNION ALL SELECT k, '提示注入模式', false, 1 FROM c WHERE k % 5 = 0""",
    "review_tiers": f"SELECT k AS doc_id, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n_critical, 2 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS n_low FROM (SELECT {_K})",
    "surviving_originals": _DOC_VALUES + r""", t AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(t, '[0-9]+|[^0-9]+'),
        lambda x: CASE WHEN regexp_full_match(x, '[0-9]{14,20}|1[3-9][0-9]{9}|0[0-9]{9,11}|[48]00[0-9]{7}') OR (regexp_full_match(x, '[0-9]{7,}') AND NOT regexp_matches(x, '^(?:19|20)[0-9]{6}')) THEN '[]' ELSE x END), '') AS masked FROM e)
      SELECT type, count(*) AS n FROM v JOIN t USING (doc_id)
      WHERE len(list_filter(range(1, greatest(2, length(original) - 4)), lambda i: contains(masked, substr(original, i, 6)))) > 0 GROUP BY type""",
    "eval_scores": _CASE_ROWS + "SELECT type, tp, fp, fn, precision, recall, support, f1 FROM f",
    "eval_macro": _CASE_ROWS + "SELECT avg(f1) AS macro_f1 FROM f WHERE type <> 'MICRO'",
    "column_kinds": "SELECT * FROM (VALUES ('序号', '默认'), ('交易日期', '日期'), ('摘要', '附言'), ('交易金额', '金额'), ('账户余额', '金额'), ('交易地点/附言', '附言'), ('对方账号与户名', '户名'), ('状态', '默认')) AS h(header, kind)",
    "cells_masked": f"""WITH h AS (SELECT o_custkey AS doc_id, o_orderkey AS row_idx, {_person('o_orderkey')} AS holder FROM orders),
      n AS (SELECT doc_id, holder, row_number() OVER (PARTITION BY doc_id ORDER BY min(row_idx)) AS n FROM h GROUP BY doc_id, holder)
      SELECT o_custkey AS doc_id, o_orderkey AS row_idx, 0 AS col_idx, '日期' AS col_type, strftime(o_orderdate, '%Y%m%d') AS masked FROM orders
      UNION ALL SELECT o_custkey, o_orderkey, 1, '金额', '[金额]' FROM orders
      UNION ALL SELECT o_custkey, o_orderkey, 2, '附言', '34069040' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') FROM orders
      UNION ALL SELECT doc_id, row_idx, 3, '户名', '[当事人_' || n || ']' FROM h JOIN n USING (doc_id, holder)""",
    "cells_restored": "SELECT o_custkey AS doc_id, true AS lossless, 2 * count(*) AS n FROM orders GROUP BY o_custkey",
    "table_companies": f"""SELECT k AS doc_id, r AS row_idx, c AS col_idx, [['[公司_1]', '转账'], ['[公司_1]', '原告：[当事人甲（原告）]'], ['[当事人甲（原告）]', '支付宝-[当事人甲（原告）]'], ['[当事人甲（原告）]', '利息']][CAST(r + 1 AS INTEGER)][CAST(c + 1 AS INTEGER)] AS masked
      FROM (SELECT {_K}), (SELECT unnest([0, 1, 2, 3]) AS r), (SELECT unnest([0, 1]) AS c)""",
    "cell_offsets": "SELECT o_custkey AS doc_id, o_orderkey AS row_idx, c AS col_idx, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, c) - 1) // 4 * 30 + [0, 9, 14, 27][CAST(c + 1 AS INTEGER)] AS \"offset\" FROM orders, (SELECT unnest([0, 1, 2, 3]) AS c)",
    "resume_pending": "SELECT doc_id AS path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "fingerprint_changed": "SELECT doc_id FROM documents WHERE doc_id % 7 = 3 OR doc_id % 11 = 0",
    "batch_report": "SELECT CASE WHEN quality = 1 THEN 'done' ELSE 'failed' END AS status, count(*) AS files, CAST(sum(toxic) AS BIGINT) AS replaced FROM labels GROUP BY 1",
    "reply_check": f"SELECT k, ['', 'lines', 'placeholders', 'originals'][CAST(k % 4 + 1 AS INTEGER)] AS faults FROM (SELECT {_K})",
    "stage_merge": f"SELECT k, k || '元|杭州法院|' || (k + 1) || '元' AS originals FROM (SELECT {_K})",
    "drift_restore": f"SELECT k, '见' || k || '号为准' AS restored FROM (SELECT {_K})",
    "mapping_markdown": f"SELECT k, '总额 ' || k || ' 元' AS original, '[金额]' AS replacement, 1 AS n FROM (SELECT {_K})",
    "redaction_boxes": f"SELECT k AS doc_id, '手机 ' || {_MOBILE} AS text FROM (SELECT {_K}) UNION ALL SELECT k, substr({_MOBILE}, 1, 5) || ' ' || substr({_MOBILE}, 6) FROM (SELECT {_K})",
    "output_names": f"SELECT k AS doc_id, '起诉状_' || k || CASE WHEN k % 2 = 0 THEN '.txt' ELSE '.docx' END AS output FROM (SELECT {_K})",
    "synthetic_recall": f"""WITH c AS (SELECT {_K}), t AS (SELECT unnest([['人名', '身份证号', '手机号'], ['公司名', '统一社会信用代码', '金额'], ['案号', '车牌号', '邮箱'], ['银行账号', '地址', '出生日期'], ['人名', '手机号', '银行账号'], ['人名', '地址', '身份证号'], ['公司名', '统一社会信用代码', '邮箱'], ['人名', '案号', '金额'], ['车牌号', '手机号', '出生日期'], ['人名', '银行账号', '金额'], ['人名', '邮箱', '地址']][CAST(k % 11 + 1 AS INTEGER)]) AS type FROM c)
      SELECT coalesce(type, 'MICRO') AS type, count(*) AS tp, 0 AS fp, 0 AS fn, 1.0 AS recall FROM t GROUP BY ROLLUP (type)""",
    "synthetic_valid": f"SELECT k, true AS id, true AS credit, true AS card FROM (SELECT {_K})",
    "bio_labels": f"SELECT k AS id, true AS whole, 3 AS begun FROM (SELECT {_K})",
    "user_rule_pass": f"SELECT k, '[审理法院]受理，尾款[金额]，由[审理法院]执行' AS masked2, '海淀法院|' || k || '元|海淀法院' AS originals FROM (SELECT {_K})",
    "reply_final": f"SELECT k, CASE WHEN k % 3 = 0 THEN '尾款[金额]，见[法院]' ELSE '尾款[金额]，见海淀法院' END AS final, ['', 'placeholders', 'form'][CAST(k % 3 + 1 AS INTEGER)] AS faults FROM (SELECT {_K})",
    "audit_counts": _DOC_VALUES + "SELECT d.doc_id, count(original) AS replaced, 0 AS network_calls FROM documents d LEFT JOIN v USING (doc_id) GROUP BY d.doc_id",
    "shared_people": f"""WITH c AS (SELECT {_K}), m AS (SELECT k, 0 AS pos, {_person()} AS name, 'plaintiff' AS role FROM c UNION ALL SELECT k, 1, {_person('k + 37')} || '明', 'defendant' FROM c
        UNION ALL SELECT k, 2, '孙宝玉', '交易对手' FROM c),
      p AS (SELECT name, min(k * 4 + pos) AS first, arg_min(role, k * 4 + pos) AS role, count(DISTINCT k) AS documents FROM m GROUP BY name)
      SELECT name, row_number() OVER (ORDER BY first) AS number, role, documents FROM p""",
    "recognised": f"SELECT k AS doc_id, '由[审理法院]审理，被告住在[地址]' AS masked FROM (SELECT {_K})",
    "discovered_names": f"SELECT k, {_person()} AS name FROM (SELECT {_K}) UNION SELECT k, {_person('k + 37')} || '明' FROM (SELECT {_K}) UNION SELECT k, {_person('k + 5')} FROM (SELECT {_K}) UNION SELECT k, {_person('k + 13')} FROM (SELECT {_K})",
    "transaction_names": f"SELECT k, {_person('k + 5')} AS name FROM (SELECT {_K}) UNION SELECT k, {_person('k + 13')} FROM (SELECT {_K})",
    "discovered_masked": f"SELECT k, '[当事人_1]欠[当事人_2]款' || k || '笔' AS masked FROM (SELECT {_K})",
    "file_names": f"SELECT k, '案卷/2024/' || CASE WHEN k % 2 = 0 THEN '原告：[当事人甲（原告）]。起诉状' ELSE '电话 [手机号] 记录' END || '.docx' AS masked_name FROM (SELECT {_K})",
    "value_frequency": _DOC_VALUES + "SELECT type, original, count(*) AS n, count(DISTINCT doc_id) AS documents FROM v GROUP BY ALL",
    "redaction_counts": f"SELECT k AS doc_id, unnest(['redacted', 'not_found', 'skipped']) AS outcome, unnest(['[手机号]', '[QQ号]', '[符号]']) AS placeholder, unnest([2, 1, 1]) AS n FROM (SELECT {_K})",
    "mapping_counts": f"SELECT k, 1 AS ord, {_MOBILE} AS original, '[手机号]' AS replacement, '手机号' AS type, 2 AS n FROM (SELECT {_K}) UNION ALL SELECT k, 2, {_MOBILE.replace('CAST(k ', 'CAST(k + 1 ')}, '[手机号]', '手机号', 1 FROM (SELECT {_K})",
    "sealed_mappings": f"SELECT k, '总额 ' || k AS text, true AS closed, 32 + 12 + 16 + strlen('总额 ' || k) AS size, true AS salted FROM (SELECT {_K})",
    "repaired": f"SELECT k, '付[金额]给[当事人_1]' || k || ' 元' AS text FROM (SELECT {_K})",
    "more_rules": f"SELECT k, kind, CASE WHEN kind = '像素' THEN '设备' || (k % 90 + 1) || '万像素，其余不变' ELSE masked END AS masked FROM (SELECT {_K}), (VALUES {_MORE_ROWS}) AS s(kind, masked)",
    "one_value_two_rules": f"SELECT k, '营业执照：[营业执照号]，转到 [营业执照号] 。' AS masked FROM (SELECT {_K})",
    "scan_first_five": f"SELECT k AS doc_id, '手机号' AS type, {_MOBILE.replace('CAST(k ', 'CAST(k + i ')} AS value, i + 1 AS rank, 7 AS n FROM (SELECT {_K}), (SELECT unnest(range(5)) AS i)",
    "surest_entities": f"SELECT k, '[当事人_1]在临平路与[公司_1]' AS masked FROM (SELECT {_K})",
    "covered_boxes": f"SELECT k, k % 30 <= 15 AS covered FROM (SELECT {_K})",
    "still_readable": f"SELECT k, CASE WHEN k % 2 = 0 THEN {_MOBILE} || '|手机' ELSE '手机' END AS values FROM (SELECT {_K})",
    "template_gate": f"SELECT k, ['', 'unknown slot', 'name', 'no slot,not Han'][CAST(k % 4 + 1 AS INTEGER)] AS faults FROM (SELECT {_K})",
    "prompts": f"SELECT k, true AS fenced FROM (SELECT {_K})",
    "known_headers": f"SELECT k, k % 6 = 0 AS is_table FROM (SELECT {_K})",
    "review_text": f"""SELECT k AS doc_id, concat_ws(chr(10), '【替换统计】', '- 手机号: 1', '【重点复核】0 【建议复核】2', '[ ] 孤立姓名候选：' || p || '（…市余杭区人民法院受理， ' || p || '…）',
        '[ ] 法院名称：杭州市余杭区人民法院（…联系 [手机号] 。杭州市余杭区人民法院受理， ' || p || '…）', '还原往返校验：一致', '【脱敏后全文】', '联系 [手机号] 。杭州市余杭区人民法院受理，', p) AS review FROM (SELECT k, {_person()} AS p FROM (SELECT {_K}))""",
    "batch_review": """SELECT doc_id AS path, concat_ws(',', CASE WHEN quality IS DISTINCT FROM 1 THEN 'failed' END, CASE WHEN toxic = 1 THEN 'critical' END) AS reasons FROM labels
      WHERE quality IS DISTINCT FROM 1 OR toxic = 1""",
    "csv_lines": """SELECT c_custkey, c_name || ',"a ""' || c_custkey || '"", b",' || c_acctbal AS line FROM customer""",
    "converted": f"""SELECT k, '标题 ' || k || chr(10) || '金额 & 链接' AS txt, '<h1>标题 ' || k || '</h1>' || chr(10) || '<p><strong>金额</strong> &amp; <a href="https://example.com/' || k || '">链接</a></p>' AS html,
      '## 标题 ' || k || chr(10) || chr(10) || '**金额**' AS md, '<p>a&lt;' || k || '</p>' AS escaped FROM (SELECT {_K})""",
    "long_spans": f"SELECT k, '写信 [邮箱] 或 [手机号] 。' AS masked, true AS lossless FROM (SELECT {_K})",
    "retyped_cells": f"SELECT k, CAST(k AS DOUBLE) AS amount, CAST(-1 AS DOUBLE) AS account FROM (SELECT {_K})",
}
