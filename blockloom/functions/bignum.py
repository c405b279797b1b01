"""Integers of up to 256 bits as decimal strings, by three limbs of 26 digits. No Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DIGITS = 78
_LIMB = 26
_BASE = "1" + "0" * _LIMB


def _dec(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def limbs(c: Column) -> list[Column]:
    """High, middle and low limb of a non-negative decimal string."""
    padded = F.lpad(c, DIGITS, "0")
    return [F.substring(padded, 1 + _LIMB * i, _LIMB).cast(f"decimal({_LIMB},0)") for i in range(3)]


def join_limbs(high: Column, middle: Column, low: Column) -> Column:
    """Decimal string of limbs in range, without leading zeros."""
    part = lambda c: F.lpad(c.cast("decimal(38,0)").cast("string"), _LIMB, "0")
    text = F.concat(high.cast("decimal(38,0)").cast("string"), part(middle), part(low))
    return F.regexp_replace(text, "^0+(?=.)", "")


def carried(high: Column, middle: Column, low: Column) -> Column:
    """Limb sums back into range, and into a string."""
    base = _dec(F.lit(_BASE))
    m = _dec(middle) + _dec(F.floor(_dec(low) / base))
    low = _dec(low) % base
    h = _dec(high) + _dec(F.floor(_dec(m) / base))
    return join_limbs(h, _dec(m) % base, low)


def total(c: Column) -> Column:
    """Aggregate: the exact sum of non-negative integers (ten billion rows and more). Nulls are left out; no rows give 0."""
    return carried(*[F.coalesce(F.sum(x), F.lit(0)) for x in limbs(c)])


def sort_key(c: Column) -> Column:
    """Text that sorts as the non-negative numbers do."""
    return F.lpad(c, DIGITS, "0")


def difference(a: Column, b: Column) -> Column:
    """a - b of two non-negative decimal strings, signed."""
    swap = sort_key(a) < sort_key(b)
    x = [F.when(swap, q).otherwise(p) for p, q in zip(limbs(a), limbs(b))]
    y = [F.when(swap, p).otherwise(q) for p, q in zip(limbs(a), limbs(b))]
    base = _dec(F.lit(_BASE))
    low = _dec(x[2]) - _dec(y[2])
    middle = _dec(x[1]) - _dec(y[1]) - F.when(low < 0, 1).otherwise(0)
    high = _dec(x[0]) - _dec(y[0]) - F.when(middle < 0, 1).otherwise(0)
    text = join_limbs(high, F.when(middle < 0, middle + base).otherwise(middle), F.when(low < 0, low + base).otherwise(low))
    return F.when(swap, F.concat(F.lit("-"), text)).otherwise(text)


def from_hex(c: Column) -> Column:
    """A minimal 0x quantity of up to 64 digits as a decimal string; null for anything else."""
    low = F.lower(c)
    digits = F.lpad(F.substring(low, 3, 64), 64, "0")
    words = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(digits, i * 8 + 1, F.lit(8)), 16, 10).cast("decimal(38,0)"))
    base, shift = _dec(F.lit(_BASE)), F.lit(1 << 32).cast("decimal(10,0)")
    zero = F.lit(0).cast("decimal(38,0)")
    start = F.struct(zero.alias("h"), zero.alias("m"), zero.alias("l"))

    def step(acc: Column, w: Column) -> Column:
        low = _dec(_dec26(acc["l"]) * shift + w)
        middle = _dec(_dec26(acc["m"]) * shift + F.floor(low / base))
        high = _dec(_dec26(acc["h"]) * shift + F.floor(middle / base))
        return F.struct(high.alias("h"), _dec(middle % base).alias("m"), _dec(low % base).alias("l"))

    whole = F.aggregate(words, start, step)
    short = F.conv(F.substring(low, 3, 15), 16, 10)  # most amounts fit a long
    return F.when(low.rlike("^0x(0|[1-9a-f][0-9a-f]{0,14})$"), short).when(low.rlike("^0x[1-9a-f][0-9a-f]{0,63}$"), join_limbs(whole["h"], whole["m"], whole["l"]))


def _dec26(c: Column) -> Column:
    return c.cast("decimal(27,0)")
