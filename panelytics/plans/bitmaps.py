"""Presence over periods as sets of bits: an array of longs, in which period p is bit p % 64 of long p div 64.

The set of an entity is a ``bit_or`` of fixed-width longs, so it is combined before the shuffle and needs no sort and no
list. Entities are then counted by their set. Overlap with an earlier period is ``b AND (b << lag)``, runs are the stretches of
ones in its digits, and what is asked for each period is a sum by bit position: 64 sums over one row for each long of a set,
instead of one row for each period (or each pair of periods) of an entity.

Periods count from 0 or more. Null periods are in no set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64


def words_for(last: int | None) -> int:
    """Longs needed for periods up to ``last``."""
    return (last or 0) // BITS + 1


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0).cast("bigint"))


def presence_bits(rows: DataFrame, by: Sequence[str], at: Column, words: int) -> DataFrame:
    """(by, bits): the set of periods ``at`` of each ``by``."""
    spot = rows.select(*by, at.cast("bigint").alias("_at"))
    bit = F.expr(f"shiftleft(1L, CAST(_at % {BITS} AS INT))")
    own = [F.bit_or(F.when(F.expr(f"_at div {BITS}") == w, bit)).alias(f"_w{w}") for w in range(words)]
    return spot.groupBy(*by).agg(*own).select(*by, F.array(*[_zero(F.col(f"_w{w}")) for w in range(words)]).alias("bits"))


def patterns(bitmaps: DataFrame, by: Sequence[str], n: str = "n") -> DataFrame:
    """(by, bits, n): how many entities have the same set."""
    return bitmaps.groupBy(*by, "bits").agg(F.count("*").alias(n))


def _words(bits: Column | str, words: int) -> list[Column]:
    return [F.get(bits, F.lit(i)) for i in range(words)]


def later(bits: Column | str, lag: Column | int, words: int) -> Column:
    """The set with every period moved up by ``lag``; what leaves the array is gone.

    Written out for each long, so that it stays compiled code; ``words`` is the length of the array.
    """
    bits, lag = F.col(bits) if isinstance(bits, str) else bits, F.lit(lag) if isinstance(lag, int) else lag
    whole, rest = F.floor(lag / BITS).cast("int"), (lag % BITS).cast("int")

    def word(i: int) -> Column:
        low = F.call_function("shiftleft", _zero(F.get(bits, F.lit(i) - whole)), rest)
        # A shift by 64 would be none, so the part below moves by 63 - rest and by one more.
        high = F.call_function("shiftrightunsigned", _zero(F.get(bits, F.lit(i - 1) - whole)), F.lit(BITS - 1) - rest)
        return low.bitwiseOR(F.shiftrightunsigned(high, 1))

    return F.array(*[word(i) for i in range(words)])


def both(a: Column, b: Column, words: int) -> Column:
    return F.array(*[x.bitwiseAND(y) for x, y in zip(_words(a, words), _words(b, words), strict=True)])


def without(a: Column, b: Column, words: int) -> Column:
    return F.array(*[x.bitwiseAND(F.bitwise_not(y)) for x, y in zip(_words(a, words), _words(b, words), strict=True)])


def size(bits: Column | str, words: int) -> Column:
    """How many periods are in the set."""
    return sum((F.bit_count(x) for x in _words(bits, words)), F.lit(0)).cast("bigint")


def _text(bits: Column | str, words: int) -> Column:
    """The set as a text of 0 and 1, the first period first."""
    return F.concat(*[F.reverse(F.lpad(F.bin(x), BITS, "0")) for x in _words(bits, words)])


def span(bits: Column | str, words: int) -> Column:
    """Periods from the first to the last one of the set; -1 for the empty set."""
    text = _text(bits, words)
    last = F.length(F.rtrim(text, F.lit("0")))
    return F.when(last > 0, last - F.instr(text, "1")).otherwise(-1).cast("bigint")


def run_lengths(bits: Column | str, words: int) -> Column:
    """Array of the lengths of the runs of consecutive periods, in order."""
    runs = F.regexp_extract_all(_text(bits, words), F.lit("1+"), F.lit(0))
    return F.transform(runs, lambda run: F.length(run).cast("bigint"))


def counts_by_period(rows: DataFrame, by: Sequence[str], bits: Column | str = "bits", n: str = "n", at: str = "period_idx") -> DataFrame:
    """(by, at, nb): for each period, the sum of ``n`` over the rows whose set has it; periods of no row are left out."""
    words = rows.select(*by, F.col(n).alias("_n"), F.posexplode(bits).alias("_w", "_b")).where("_b <> 0")
    sums = [F.sum(F.expr(f"_n * getbit(_b, {i})")).alias(f"_s{i}") for i in range(BITS)]
    wide = words.groupBy(*by, "_w").agg(*sums)
    spots = wide.select(*by, "_w", F.posexplode(F.array(*[f"_s{i}" for i in range(BITS)])).alias("_i", "nb")).where("nb > 0")
    return spots.select(*by, (F.col("_w") * BITS + F.col("_i")).cast("bigint").alias(at), "nb")
