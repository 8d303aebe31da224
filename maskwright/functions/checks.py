"""Check digits and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights and check characters of GB 11643 and GB 32100.
ID_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CHECK = "10X98765432"
CREDIT_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
CREDIT_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)


def _weighted(value: Column, weights: tuple[int, ...], digit) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + digit(F.substring(value, i + 1, 1)) * w
    return total


def valid_id(value: Column) -> Column:
    """Eighteen characters whose last is the check character of the first seventeen digits."""
    total = _weighted(value, ID_WEIGHTS, lambda c: F.ascii(c) - 48)
    return value.rlike("^[0-9]{17}[0-9Xx]$") & (F.upper(F.substring(value, 18, 1)) == F.substring(F.lit(ID_CHECK), total % 11 + 1, F.lit(1)))


def valid_birth_date(value: Column) -> Column:
    """Characters 7 to 14 of eighteen are a calendar date from 1900 to 2100."""
    day = F.substring(value, 7, 8)
    return (F.length(value) == 18) & day.rlike("^(19[0-9]{2}|20[0-9]{2}|2100)[0-9]{4}$") & F.try_to_timestamp(day, F.lit("yyyyMMdd")).isNotNull()


def plausible_id(value: Column) -> Column:
    return valid_id(value) | valid_birth_date(value)


def valid_credit_code(value: Column) -> Column:
    """Eighteen characters of the credit code's alphabet with their check character."""
    v = F.upper(value)
    total = _weighted(v, CREDIT_WEIGHTS, lambda c: F.instr(F.lit(CREDIT_ALPHABET), c) - 1)
    return v.rlike(f"^[{CREDIT_ALPHABET}]{{17}}.$") & (F.length(v) == 18) & (F.substring(v, 18, 1) == F.substring(F.lit(CREDIT_ALPHABET), (F.lit(31) - total % 31) % 31 + 1, F.lit(1)))


def valid_card(value: Column) -> Column:
    """Twelve digits or more that pass Luhn."""
    return value.rlike("^[0-9]{12,}$") & F.coalesce(F.call_function("luhn_check", value), F.lit(False))


def validated(kind: Column, value: Column) -> Column:
    """Whether a value carries a check digit that holds; kinds without one are never validated."""
    return (
        F.when(kind == "身份证号", valid_id(value))
        .when(kind == "统一社会信用代码", valid_credit_code(value))
        .when(kind == "银行账号", valid_card(value))
        .otherwise(F.lit(False))
    )


def confidence(kind: Column, value: Column) -> Column:
    """How sure a scan is of a value: by check digit or birth date where the kind has one."""
    id_sure = F.when(F.length(value) < 18, 0.5).when(valid_id(value), 1.0).when(valid_birth_date(value), 0.6).otherwise(0.0)
    return (
        F.when(kind == "身份证号", id_sure)
        .when(kind == "统一社会信用代码", F.when(valid_credit_code(value), 1.0).otherwise(0.5))
        .when(kind == "银行账号", F.when(valid_card(value), 1.0).otherwise(0.6))
        .otherwise(1.0)
    )
