"""Order statistics of groups of any size, by way of value histograms.

A sort of a whole group in one task does not survive a group that holds a
third of the data. Equal values are therefore counted first. The number of
*distinct* integer weights in a group with total weight V is at most about
sqrt(2 V) (their sum cannot exceed V), so running totals over that histogram
are small. Ties are then ranked inside cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics import PANEL_KEYS, WEIGHT
from panelytics.plans.joins import attach, few
from panelytics.session import stage

# Integer ids are unique in a group, so a cell of this many consecutive ids
# cannot hold more rows than that.
ID_CELL_BITS = 20
# Other ids go to 16**3 cells by hash.
HASH_CELL_DIGITS = 3
# Most distinct values that a cell of ``running_counts`` may hold, and bits that one refinement looks at.
VALUE_CELL_ROWS = 1 << 20
RADIX_BITS = 12


def tie_cell(df: DataFrame, column: str) -> Column:
    """Cell of an id; ordering by (cell, id) is the tie order of ``curve``."""
    if isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(F.shiftright(F.col(column).cast("bigint"), ID_CELL_BITS), F.lit(-1).cast("bigint"))
    return F.coalesce(F.substring(F.md5(F.col(column).cast("string")), 1, HASH_CELL_DIGITS), F.lit(""))


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def rows_with_cell(panel: DataFrame, by: Sequence[str], weight: str, tie: Sequence[str]) -> DataFrame:
    """Rows that can be ranked, with the cell of their id.

    Said once up front, the filter is the same in every branch of a plan, so
    the exchanges of rows and cells can be reused.
    """
    return _complete(panel, [*by, weight]).withColumn("_cell", tie_cell(panel, tie[0]))


def count_cells(rows: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    return rows.groupBy(*by, weight, "_cell").agg(F.count("*").alias("_n"))


def panel_blocks(
    panel: DataFrame, by: Sequence[str] = PANEL_KEYS, weight: str = WEIGHT, tie: Sequence[str] | None = None
) -> DataFrame:
    """The weight histogram of a panel with its running totals.

    With ``tie`` it is summed from the cells that ``curve`` counts, so a plan
    that has both reads the panel once for them.
    """
    if tie is not None:
        return weight_blocks(count_cells(rows_with_cell(panel, by, weight, tie), by, weight), by, weight)
    rows = _complete(panel, [*by, weight])
    return weight_blocks(rows.groupBy(*by, weight).agg(F.count("*").alias("_n")), by, weight)


def weight_blocks(cells: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """One row per distinct weight: rows and weight above it, and group totals."""
    group = Window.partitionBy(*by)
    down = group.orderBy(F.col(weight).desc())
    above = down.rowsBetween(Window.unboundedPreceding, -1)
    blocks = cells.groupBy(*by, weight).agg(F.sum("_n").alias("_ties"))
    mass = F.col("_ties") * F.col(weight)
    return blocks.select(
        *by,
        weight,
        "_ties",
        F.coalesce(F.sum("_ties").over(above), F.lit(0)).alias("_above"),
        F.coalesce(F.sum(mass).over(above), F.lit(0)).alias("_mass_above"),
        F.sum("_ties").over(group).alias("nb_pages"),
        F.sum(mass).over(group).alias("tot_views"),
        F.lead(weight).over(down).alias("_next_block"),
    )


def curve(
    panel: DataFrame,
    by: Sequence[str] = PANEL_KEYS,
    weight: str = WEIGHT,
    tie: Sequence[str] = ("page_id",),
    lim: int | None = None,
) -> DataFrame:
    """Ranks and the cumulative curve of every group, in one pass.

    Adds ``rank`` (weight descending, then tie order), ``fractional_rank``
    (mean rank of the ties), ``cum_views``, ``tot_views``, ``nb_pages`` and
    ``next_views`` (weight at the following rank). The tie order is the id
    itself for integer ids and (md5 prefix, id) for others. Rows without a
    group or a weight have no rank and are left out. With ``lim`` only the first ``lim`` ranks
    of each group are kept, and cells beyond them never meet the rows.
    """
    rows = rows_with_cell(panel, by, weight, tie)
    cells = count_cells(rows, by, weight)
    blocks = weight_blocks(cells, by, weight)
    before = (
        Window.partitionBy(*by, weight).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        cells.withColumn("_skip", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
        .join(blocks, [*by, weight])
    )
    if lim is not None:
        offsets = offsets.where(F.col("_above") + F.col("_skip") < lim)
    in_cell = Window.partitionBy(*by, weight, "_cell").orderBy(
        *[F.col(c).asc_nulls_last() for c in tie]
    )
    place = F.row_number().over(in_cell)
    cell = [*by, weight, "_cell"]
    # With a limit the join drops most rows before they are sorted; without one
    # the window goes first, as its order serves the join too.
    if lim is not None:
        ranked = rows.join(offsets, cell).withColumn("_place", place)
    else:
        ranked = rows.withColumn("_place", place).join(offsets, cell)
    ranked = ranked.withColumn("rank", (F.col("_above") + F.col("_skip") + F.col("_place")).cast("bigint"))
    w = F.col(weight)
    into = F.col("rank") - F.col("_above")
    ranked = ranked.select(
        *panel.columns,
        "rank",
        (F.col("_above") + (F.col("_ties") + 1) / F.lit(2.0)).alias("fractional_rank"),
        (F.col("_mass_above") + into * w).alias("cum_views"),
        "tot_views",
        "nb_pages",
        F.when(into < F.col("_ties"), w).otherwise(F.col("_next_block")).alias("next_views"),
    )
    return ranked if lim is None else ranked.where(F.col("rank") <= lim)


def fractional_ranks(
    panel: DataFrame, by: Sequence[str] = PANEL_KEYS, weight: str = WEIGHT
) -> DataFrame:
    """Only the mean rank of the ties: no order inside ties is needed."""
    panel = _complete(panel, [*by, weight])
    blocks = panel_blocks(panel, by, weight).select(
        *by,
        weight,
        (F.col("_above") + (F.col("_ties") + 1) / F.lit(2.0)).alias("fractional_rank"),
    )
    # At most sqrt(2 V) rows per group: with its size known from its files it is broadcast, and the
    # panel stays where it is, unless it is long.
    return attach(panel, blocks, [*by, weight])


def order_bits(df: DataFrame, value: str) -> Column:
    """A long in the order of the values, equal only for equal ones.

    For floats these are the bits of the number itself (sign apart), made by exact arithmetic: the exponent is corrected
    against the powers around it, and a number over a power of two is exact. NaN comes last and the two zeros are one.
    """
    kind, v = df.schema[value].dataType, F.col(value)
    if isinstance(kind, T.DateType):
        return F.unix_date(v).cast("bigint")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(v.cast("timestamp"))
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (v * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("bigint")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return v.cast("bigint")
    if not isinstance(kind, (T.FloatType, T.DoubleType)):
        raise ValueError(f"no order of bits for {kind.simpleString()}")
    x = v.cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), guess)
    exponent = F.when(power > size, guess - 1).when(size >= 2 * power, guess + 1).otherwise(guess)
    normal = (exponent + 1022) * F.lit(1 << 52) + ((size / F.pow(F.lit(2.0), exponent)) * float(1 << 52)).cast("bigint")
    # Below the least normal number the bits count multiples of the least number.
    tiny = (size * float(1 << 52) * 2.0**1000 * 2.0**22).cast("bigint")
    bits = F.when(size == 0, F.lit(0)).when(size < 2.0**-1022, tiny).when(size == float("inf"), F.lit(2047 << 52)).otherwise(normal)
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(x < 0, -bits).otherwise(bits).cast("bigint")


def _refined(low: Column, high: Column) -> Column:
    """How far to shift so that, of the bits in which the ends differ, the leading ones are left."""
    length = F.length(F.bin(low.bitwiseXOR(high)))
    return F.greatest(length - RADIX_BITS, F.lit(0)).cast("int")


def value_cells(hist: DataFrame, keys: Sequence[str], value: str, most: int | None = None) -> DataFrame:
    """Rows of ``hist`` (one for each key and value) with ``_cell``, numbered in the order of values inside a key.

    A key is one cell if it has at most ``most`` values. A cell over that is split by the leading bits of its own span, and
    again where that is not enough; each round reads the stored rows once and looks only up cells that are still too large.
    """
    most, keys = VALUE_CELL_ROWS if most is None else most, list(keys)
    rows = hist.withColumn("_k", order_bits(hist, value)).withColumn("_cell", F.lit(-(1 << 63)).cast("bigint"))
    while True:
        ends = (F.min("_k").alias("_low"), F.max("_k").alias("_high"))
        sizes = rows.groupBy(*keys, "_cell").agg(F.count("*").alias("_size"), *ends).where(F.col("_size") > most)
        heavy = few(sizes.select(*keys, "_cell", _refined(F.col("_low"), F.col("_high")).alias("_shift")))
        if heavy.isEmpty():
            return rows.drop("_k")
        start = F.call_function("shiftleft", F.call_function("shiftright", F.col("_k"), F.col("_shift")), F.col("_shift"))
        rows = rows.join(heavy, [*keys, "_cell"], "left").withColumn("_cell", F.coalesce(start, F.col("_cell"))).drop("_shift")


def running_counts(
    hist: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str], wanted: Column | None = None
) -> DataFrame:
    """For every value: sums of ``measures`` over all smaller values of its key.

    ``hist`` has one row per (keys, value), of any size. Values are put in cells of at most ``VALUE_CELL_ROWS``
    (``value_cells``); totals run over cells first and inside cells second. Adds ``{m}_below`` and ``{m}_total``. ``wanted``
    tells of a cell, by ``_{m}_skip``, ``_{m}`` and ``{m}_total``, whether its rows are asked for; others are left out unsorted.
    """
    keys = list(keys)
    # Read again for every round of cells, their totals and the rows, so written out once.
    hist = stage(_complete(hist, keys), "values")
    rows = value_cells(hist, keys, value)
    cells = rows.groupBy(*keys, "_cell").agg(*[F.sum(m).alias(f"_{m}") for m in measures])
    group = Window.partitionBy(*keys)
    before = group.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        *keys,
        "_cell",
        *[f"_{m}" for m in measures],
        *[F.coalesce(F.sum(f"_{m}").over(before), F.lit(0)).alias(f"_{m}_skip") for m in measures],
        *[F.sum(f"_{m}").over(group).alias(f"{m}_total") for m in measures],
    )
    offsets = (offsets if wanted is None else offsets.where(wanted)).drop(*[f"_{m}" for m in measures])
    in_cell = (
        Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = rows.join(offsets, [*keys, "_cell"])
    return joined.select(
        *hist.columns,
        *[
            (F.col(f"_{m}_skip") + F.coalesce(F.sum(m).over(in_cell), F.lit(0))).alias(f"{m}_below")
            for m in measures
        ],
        *[f"{m}_total" for m in measures],
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]
) -> DataFrame:
    """Interpolated quantiles of groups of any size, one row per key."""
    known = df.where(F.col(value).isNotNull())
    hist = known.groupBy(*keys, value).agg(F.count("*").alias("n"))
    spots = [F.lit(float(q)) * (F.col("n_total") - 1) for q in quantiles.values()]
    ends = [(F.col("_n_skip") <= i) & (i < F.col("_n_skip") + F.col("_n")) for s in spots for i in (F.floor(s), F.ceil(s))]
    # Only cells that hold one of the places are sorted.
    spread = running_counts(hist, keys, value, ["n"], wanted=reduce(or_, ends))

    def at(index: Column) -> Column:
        hit = (F.col("n_below") <= index) & (index < F.col("n_below") + F.col("n"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    aggs = []
    for name, q in quantiles.items():
        spot = F.lit(float(q)) * (F.col("n_total") - 1)
        aggs += [
            at(F.floor(spot)).alias(f"_lo_{name}"),
            at(F.ceil(spot)).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_part_{name}"),
        ]
    found = spread.groupBy(*keys).agg(*aggs)
    return found.select(
        *keys,
        *[
            (
                F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_part_{n}")
            ).alias(n)
            for n in quantiles
        ],
    )
