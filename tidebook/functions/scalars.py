"""Column expressions of the market domain: price keys, rounding, fees, outcomes, flags, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prices are compared as whole millionths.
PRICE_SCALE = 1_000_000
#: A size at or under this is no size.
NO_SIZE = 1e-9
#: Health flags that make a market unfit for use, fixed by the data contract.
EXCLUDING_FLAGS = ["OPEN", "NOCLOB", "LATE", "GAP", "NORES", "SETTLE"]


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounds half towards positive infinity, also below zero, where Spark's round goes away from zero."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) if digits == 0 else F.floor(x * scale + 0.5) / F.lit(float(scale))


def price_key(price: Column) -> Column:
    return half_up(price * PRICE_SCALE).cast("long")


def mirror_key(key: Column) -> Column:
    """The same level seen from the other side of a binary market."""
    return F.lit(PRICE_SCALE).cast("long") - key


def scaled_price(price: Column) -> Column:
    """A double price as an integer count of 1e-18, by eight decimals."""
    return half_up(price * 1e8).cast("decimal(28,0)") * F.lit(10_000_000_000).cast("decimal(11,0)")


def fee_per_share(price: Column, rate: Column, exponent: Column) -> Column:
    return rate * F.pow(price * (F.lit(1.0) - price), exponent)


def taker_fee(size: Column, price: Column, rate: Column, exponent: Column) -> Column:
    """Fees are charged in steps of 1e-5."""
    return half_up(size * fee_per_share(price, rate, exponent), 5)


def maker_fee_equivalent(size: Column, price: Column, rate: Column, exponent: Column) -> Column:
    return size * fee_per_share(price, rate, exponent)


def maker_rebate(ours: Column, total: Column, taker_fees: Column, rebate_rate: Column) -> Column:
    return F.when(total <= 0, F.lit(0.0)).otherwise(ours / total * rebate_rate * taker_fees)


def same_price(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Null equals null and nothing else; others within the tolerance."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) < tolerance)


def window_start(ms: Column, length_ms: int) -> Column:
    """Start of the epoch-aligned window that holds a time in milliseconds."""
    return ms - F.pmod(ms, F.lit(length_ms))


def slug(prefix: str, start_ms: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), (start_ms / 1000).cast("long").cast("string"))


def outcome(start: Column, end: Column, tie: str = "UP") -> Column:
    """UP or DOWN by the move of the reference price; a tie goes to the configured side; null without both prices."""
    return F.when(end > start, "UP").when(end < start, "DOWN").when(end == start, tie)


def flag_list(*flags: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the given order, joined by commas."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in flags])), ",")


def excluded(flags: Column) -> Column:
    return F.arrays_overlap(F.split(flags, ","), F.array(*map(F.lit, EXCLUDING_FLAGS)))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 code units' low values, as an unsigned long; short strings only."""
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(1 << 32))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(2166136261).cast("long"), step)
