"""Exact integers: 128-bit values as canonical decimal text beside a sign tag, as columns; no value is ever rounded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNED, UNSIGNED = "signed", "unsigned"
#: Digits of the widest values.
_LEAST, _MOST, _MOST_UNSIGNED = str(2**127), str(2**127 - 1), str(2**128 - 1)
_WIDTH = len(_MOST_UNSIGNED)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "^-", "")


def _at_most(digits: Column, most: str) -> Column:
    """Canonical digits, compared by length and then as text."""
    return (F.length(digits) < len(most)) | ((F.length(digits) == len(most)) & (digits <= most))


def is_exact(sign: Column, value: Column) -> Column:
    """Whether ``value`` is canonical decimal text in the range of its sign: no plus, no needless zero, no minus zero. Nulls and other tags are not."""
    signed = value.rlike(r"^(0|-?[1-9][0-9]*)\z") & F.when(value.startswith("-"), _at_most(_digits(value), _LEAST)).otherwise(_at_most(value, _MOST))
    unsigned = value.rlike(r"^(0|[1-9][0-9]*)\z") & _at_most(value, _MOST_UNSIGNED)
    return F.coalesce(F.when(sign == SIGNED, signed).when(sign == UNSIGNED, unsigned), F.lit(False))


def order_key(value: Column) -> Column:
    """Text of one width that sorts as the exact integers do, of either sign; nines' complement below zero."""
    padded = F.lpad(_digits(value), _WIDTH, "0")
    return F.when(value.startswith("-"), F.concat(F.lit("0"), F.translate(padded, "0123456789", "9876543210"))).otherwise(F.concat(F.lit("1"), padded))


def encode(sign: Column, value: Column) -> Column:
    """The JSON object of an exact integer; null for what is none."""
    return F.when(is_exact(sign, value), F.to_json(F.struct(sign.alias("sign"), value.alias("value"))))


def decode(text: Column) -> Column:
    """(sign, value) of a JSON object, or null: exactly these two members, a string each, the value canonical and in range."""
    keys = F.sort_array(F.json_object_keys(text))
    sign, value = F.get_json_object(text, "$.sign"), F.get_json_object(text, "$.value")
    strings = text.rlike(r'"value"\s*:\s*"') & text.rlike(r'"sign"\s*:\s*"')
    good = F.coalesce(keys == F.array(F.lit("sign"), F.lit("value")), F.lit(False)) & strings & is_exact(sign, value)
    return F.when(good, F.struct(sign.alias("sign"), value.alias("value")))
