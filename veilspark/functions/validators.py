"""Checks on candidate values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import dihedral_table, position_table


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def is_card(value: Column) -> Column:
    """13 to 19 digits with a right Luhn sum."""
    d = digits(value)
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def is_aadhaar(value: Column) -> Column:
    """Twelve digits whose Verhoeff sum, from the right, is 0."""
    d = F.reverse(digits(value))
    table = F.array(*[F.lit(x) for x in dihedral_table()])
    place = F.array(*[F.lit(x) for x in position_table()])

    def step(c: Column, i: Column) -> Column:
        digit = F.substring(d, i + 1, F.lit(1)).cast("int")
        return F.element_at(table, c * 10 + F.element_at(place, (i % 8) * 10 + digit + 1) + 1)

    return (F.length(d) == 12) & (F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step) == 0)


def is_ipv4(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda x: x.cast("int") <= 255)


def is_phone(value: Column) -> Column:
    """10 to 15 digits, more than two of them different."""
    d = digits(value)
    return F.length(d).between(10, 15) & (F.size(F.array_distinct(F.split(d, ""))) > 2)


def is_ssn(value: Column) -> Column:
    """No area 000, 666 or 9xx, no group 00, no serial 0000."""
    return ~value.rlike("^(?:000|666|9)") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")


CHECKS = {"luhn": is_card, "verhoeff": is_aadhaar, "ipv4": is_ipv4, "phone": is_phone, "ssn": is_ssn}
