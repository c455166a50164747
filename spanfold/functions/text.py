"""Expressions with exact parsing and formatting rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import PROMOTED_TYPES


def strict_int(x: Column) -> Column:
    """A 32-bit integer without blanks or a fraction, else null."""
    return F.when(x.rlike(r"\A[+-]?[0-9]+\z"), x.try_cast("int"))


def strict_double(x: Column) -> Column:
    """A number without blanks or a type letter, else null."""
    number = x.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
    special = x.rlike(r"(?i)\A[+-]?(inf|infinity|nan)\z")
    return F.when(number | special, x.try_cast("double"))


def strict_bool(x: Column) -> Column:
    """Exactly ``true`` or ``false``, else null."""
    return F.when(x == "true", True).when(x == "false", False)


def strict(x: Column, data_type: str) -> Column:
    parse = {"integer": strict_int, "double": strict_double, "boolean": strict_bool}.get(data_type.lower())
    return parse(x) if parse else x.cast(PROMOTED_TYPES["string"])


def plain_double(text: Column) -> Column:
    """A double's JSON text without an exponent or a needless fraction: 5.0 is 5 and 1e10 is 10000000000."""
    value = text.try_cast("double")
    # The shortest decimal of a double has at most 17 digits; decimals hold those within 10^-20 and 10^18.
    exact = F.regexp_replace(F.regexp_replace(value.cast("string").try_cast("decimal(38,20)").cast("string"), r"0+$", ""), r"\.$", "")
    inner = (F.abs(value) < 1e18) & ((F.abs(value) >= 1e-6) | (value == 0))
    return F.when(value.isNull() | F.isnan(value), F.when(F.isnan(value), F.lit("NaN")).otherwise(text)).when(
        inner, F.when(exact == "-0", F.lit("0")).otherwise(exact)
    ).when(F.abs(value) == float("inf"), F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))).otherwise(
        F.format_string("%.0f", value)
    )


def first_non_empty(*values: Column) -> Column:
    """The first value that is not blank, as it stands."""
    return F.coalesce(*[F.when(F.trim(v) != "", v) for v in values])


def hex_to_base64(x: Column) -> Column:
    """Base64 of the bytes that a hexadecimal text stands for; other texts pass through."""
    return F.when(x.rlike(r"\A([0-9a-fA-F]{2})*\z"), F.base64(F.unhex(x))).otherwise(x)


def key_containing(attributes: Column, part: str) -> Column:
    """The value of the first key, in order, that contains ``part``."""
    keys = F.sort_array(F.map_keys(F.map_filter(attributes, lambda k, v: k.contains(part) & v.isNotNull())))
    return F.element_at(attributes, F.get(keys, F.lit(0)))
