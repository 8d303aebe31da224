"""Inline marks for spans found by ordered passes over a text column.

A pass wraps what it finds: open mark, one rule character, the original, close mark. Every later pattern
ends with a guard that refuses to match inside a span, so the order of the passes settles conflicts, and
no coordinates have to be carried along. At the end one extraction gives all spans in text order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE, SEP, MID, JOINT = (chr(0xE010 + i) for i in range(5))
_FIRST_CODE = 0xE100
#: Characters that a guard looks ahead for a close mark. Longer spans get joints, which a guard knows as well.
REACH = 2000
GUARD = f"(?![^{OPEN}{CLOSE}{JOINT}]{{0,{REACH}}}+[{CLOSE}{JOINT}])"
_LONG = f"{OPEN}[^{OPEN}{CLOSE}{JOINT}]{{{REACH // 2 + 1}}}"
_STRETCH = rf"(?:{OPEN}|\G(?!^))[^{OPEN}{CLOSE}{JOINT}]{{{REACH // 2}}}"
SPAN = f"{OPEN}[^{CLOSE}]*{CLOSE}"


def code(k: int) -> str:
    """The character that stands for rule ``k``."""
    return chr(_FIRST_CODE + k)


def code_number(c: Column) -> Column:
    return F.ascii(c) - F.lit(_FIRST_CODE)


def gateway() -> int:
    """What columns are bound to: those made once can be used again as long as it is the same."""
    from pyspark import SparkContext

    return id(SparkContext._gateway)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def holds_any(text: Column, chars: str) -> Column:
    """Whether a text holds one of some characters: much cheaper than a search by a pattern."""
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(c)) for c in chars))


def unmarked_input(text: Column) -> Column:
    """The text without the characters that marks are made of."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{OPEN}-{JOINT}{chr(_FIRST_CODE)}-{chr(_FIRST_CODE + 0xFF)}]", "")


def jointed(text: Column) -> Column:
    """Spans too long for a guard's reach, with joints inside; ``spans`` takes them out again."""
    return let(text, lambda t: F.when(t.rlike(_LONG), F.regexp_replace(t, _STRETCH, f"$0{JOINT}")).otherwise(t))


def mark(text: Column, rule: int, pattern: str, label_first: bool = False) -> Column:
    """Wrap whole matches, or with ``label_first`` group 2 behind the label in group 1."""
    open_ = OPEN + code(rule)
    return F.regexp_replace(text, pattern + GUARD, f"$1{open_}$2{CLOSE}" if label_first else f"{open_}$0{CLOSE}")


def mark_if(text: Column, rule: int, pattern: str, valid) -> Column:
    """Wrap those whole matches of which ``valid`` (a function of a column) says so."""

    def judge(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, pattern + GUARD, f"{SEP}$0{SEP}"), SEP, -1)
        chosen = F.transform(parts, lambda p, i: F.when((i % 2 == 1) & valid(p), F.concat(F.lit(OPEN + code(rule)), p, F.lit(CLOSE))).otherwise(p))
        return F.when(t.rlike(pattern), F.array_join(chosen, "")).otherwise(t)

    return let(text, judge)


#: Numbers whose sums are formed one by one; longer arrays are summed by blocks of so many.
_BLOCK = 32


def running(numbers: Column, levels: int = 2) -> Column:
    """Sums of an array up to each place, its own number included, in time that grows with the array.

    Blocks are summed by themselves, and their totals in the same way a level higher.
    """
    total = lambda x: F.aggregate(x, F.lit(0), lambda acc, y: acc + y)
    plain = lambda x: F.transform(x, lambda _, i: total(F.slice(x, 1, i + 1)))
    if not levels:
        return plain(numbers)

    def blocked(x: Column) -> Column:
        def joined(parts: Column) -> Column:
            def shifted(before: Column) -> Column:
                return F.flatten(F.transform(parts, lambda part, b: F.transform(part, lambda _, i: F.coalesce(F.get(before, b - 1), F.lit(0)) + total(F.slice(part, 1, i + 1)))))

            return let(running(F.transform(parts, total), levels - 1), shifted)

        return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, _BLOCK)), joined)

    return let(numbers, lambda x: F.when(F.size(x) <= _BLOCK, plain(x)).otherwise(blocked(x)))


def spans(marked: Column) -> Column:
    """array<struct<rule, payload>> in text order."""
    found = F.regexp_extract_all(marked, F.lit(f"{OPEN}([^{CLOSE}]*){CLOSE}"), F.lit(1))
    return F.transform(found, lambda s: F.struct(code_number(F.substring(s, 1, 1)).alias("rule"), F.replace(F.substring(s, 2, 1 << 30), F.lit(JOINT), F.lit("")).alias("payload")))


def gaps(marked: Column) -> Column:
    """The text between spans: one element more than there are spans."""
    return F.split(marked, SPAN, -1)


def weave(between: Column, values: Column) -> Column:
    """Gaps and values in turn."""
    return F.concat(F.array_join(F.zip_with(F.slice(between, F.lit(1), F.size(values)), values, lambda g, v: F.concat(g, v)), ""), F.element_at(between, -1))
