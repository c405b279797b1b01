"""Hex text as Columns. Stored columns are normalised once, so that equality reaches the scan as a pushed filter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_QUANTITY = "^0x(0|[1-9a-f][0-9a-f]{0,15})$"


def bare(value: str) -> str:
    """A literal without 0x, in lower case."""
    value = value.lower()
    return value[2:] if value.startswith("0x") else value


def strip(c: Column) -> Column:
    """Without 0x, in lower case."""
    low = F.lower(c)
    return F.when(low.startswith("0x"), F.substring(low, 3, 1 << 30)).otherwise(low)


def equals(c: Column, literal: str) -> Column:
    """Equal text after optional 0x and case; null never matches."""
    return strip(c) == F.lit(bare(literal))


def among(c: Column, literals: list[str]) -> Column:
    return strip(c).isin([bare(x) for x in literals])


def begins(c: Column, prefix: str) -> Column:
    """Input begins with the selector; an empty selector matches nothing, nor does shorter input."""
    return strip(c).startswith(bare(prefix)) if bare(prefix) else F.lit(False)


def quantity(c: Column) -> Column:
    """0x and minimal hex as a long; null for anything else or beyond 63 bits."""
    low = F.lower(c)
    return F.when(low.rlike(_QUANTITY), F.conv(F.substring(low, 3, 16), 16, 10).try_cast("long"))


def unsigned(c: Column) -> Column:
    """0x and minimal hex of up to 64 bits as decimal(20, 0): the whole range, where a long has but half."""
    low = F.lower(c)
    return F.when(low.rlike(_QUANTITY), F.conv(F.substring(low, 3, 16), 16, 10).try_cast("decimal(20,0)"))


def fixed(c: Column, size: int) -> Column:
    """Exactly ``size`` bytes of hex as lower-case 0x text; null for anything else."""
    low = F.lower(c)
    return F.when(low.rlike(f"^0x[0-9a-f]{{{2 * size}}}$"), low)


def hash32(c: Column) -> Column:
    return fixed(c, 32)


def address(c: Column) -> Column:
    return fixed(c, 20)


def data(c: Column) -> Column:
    """Hex of whole bytes, any number of them."""
    low = F.lower(c)
    return F.when(low.rlike("^0x([0-9a-f]{2})*$"), low)


def to_binary(c: Column) -> Column:
    """Bytes of optional-0x hex; bad hex raises."""
    out = F.unhex(strip(c))
    return F.when(c.isNull() | out.isNotNull(), out).otherwise(F.raise_error(F.lit("not hexadecimal")).cast("binary"))


def from_binary(c: Column) -> Column:
    return F.lower(F.hex(c))
