"""Validators, normalisers and type detectors of single values, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.textnorm import SP, SPACES, js_trim, once

CURRENCY = r"(?:Kč|CZK|EUR|€|USD|\$)"


def no_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"{SP}+", "")


def one_space(c: Column) -> Column:
    return F.regexp_replace(c, f"{SP}+", " ")


def first_comma(c: Column) -> Column:
    """The first comma becomes a dot."""
    return F.regexp_replace(c, "(?s)^([^,]*),", "$1.")


def is_birth_number(c: Column) -> Column:
    return no_spaces(c).rlike(r"^[0-9]{6}/[0-9]{3,4}$")


def is_iban(c: Column) -> Column:
    return F.upper(no_spaces(c)).rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$")


def is_bank_account(c: Column) -> Column:
    return no_spaces(c).rlike(r"^([0-9]{0,6}-)?[0-9]{2,10}/[0-9]{4}$")


def is_amount(c: Column) -> Column:
    return js_trim(one_space(c)).rlike(rf"(?iu)^[0-9]{{1,3}}([ ,.][0-9]{{3}})*([.,][0-9]{{1,2}})?{SP}*{CURRENCY}?$")


def is_rpsn(c: Column) -> Column:
    return first_comma(no_spaces(c)).rlike(r"^[0-9]{1,3}(\.[0-9]{1,2})?%?$")


def is_date(c: Column) -> Column:
    c = js_trim(c)
    return c.rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}$") | c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")


DETECTORS = [("birthNumber", is_birth_number), ("iban", is_iban), ("bankAccount", is_bank_account), ("rpsn", is_rpsn), ("date", is_date), ("amount", is_amount)]


def value_type(c: Column) -> Column:
    """The first type that fits; an empty or null value is unknown."""
    out = F.lit("text")
    for name, fits in reversed(DETECTORS):
        out = F.when(fits(js_trim(c)), name).otherwise(out)
    return F.when(F.coalesce(c, F.lit("")) == "", "unknown").otherwise(out)


def normalize_value(c: Column, kind: Column) -> Column:
    t = js_trim(c)
    out = (
        F.when(kind == "birthNumber", F.regexp_replace(no_spaces(t), r"^(.*?)([0-9]{6})([0-9]{3,4})", "$1$2/$3"))
        .when(kind == "iban", F.upper(no_spaces(t)))
        .when(kind == "bankAccount", no_spaces(t))
        .when(kind == "amount", one_space(t))
        .when(kind == "rpsn", first_comma(no_spaces(t)))
        .when(kind == "date", t)
        .otherwise(F.lower(t))
    )
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(out)


def _number(c: Column, start: int, n: int) -> Column:
    return F.substring(c, start, n).try_cast("int")


def plausible_birth_number(c: Column) -> Column:
    """Nine or ten digits, whatever lies between them, with a month (less 50 for women) and a day; no checksum, no calendar."""

    def plausible(d: Column) -> Column:
        month = _number(d, 3, 2)
        month = F.when(month > 50, month - 50).otherwise(month)
        return F.coalesce(d.rlike("^[0-9]{9,10}$") & month.between(1, 12) & _number(d, 5, 2).between(1, 31), F.lit(False))

    return once(F.regexp_replace(c, "[^0-9]", ""), plausible)


def valid_company_id(c: Column, official: bool = False) -> Column:
    """Weighted checksum of eight digits; official: the public rule for remainders 0 and 1."""
    last = F.lit("10987654321" if official else "01987654321")  # by the remainder

    def valid(c: Column) -> Column:
        total = sum((_number(c, i + 1, 1) * (8 - i) for i in range(7)), F.lit(0))
        return F.coalesce(c.rlike("^[0-9]{8}$") & (F.substring(last, total % 11 + 1, F.lit(1)) == F.substring(c, 8, 1)), F.lit(False))

    return once(c, valid)


def table_type(c: Column) -> Column:
    number = js_trim(c).rlike(rf"^[{SPACES}0-9.,+\-/]++[A-Za-zčČ]*\.?-?$")
    return F.when((F.coalesce(c, F.lit("")) != "") & number, "number").otherwise("text")


def absolute_value(c: Column, kind: Column) -> Column:
    return F.when(kind == "number", F.regexp_replace(c, "[^0-9]", "")).otherwise("")


def export_type(c: Column) -> Column:
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "empty")
        .when(c.rlike(r"^[0-9]{6}/[0-9]{3,4}$"), "birthNumber")
        .when(c.rlike(rf"(?iu)^[0-9]+(?:[.,][0-9]+)?{SP}*(?:Kč|CZK|€|EUR)$"), "currency")
        .when(c.rlike(rf"^(\+420{SP}?)?[0-9]{{3}}{SP}?[0-9]{{3}}{SP}?[0-9]{{3}}$"), "phone")
        .when(c.rlike(rf"^[A-Z][a-z]+{SP}+[A-Z][a-z]+$"), "name")
        .when(c.rlike("^[0-9]+$"), "number")
        .when(c.rlike("^[0-9]+/[0-9]+$"), "fraction")
        .otherwise("text")
    )
