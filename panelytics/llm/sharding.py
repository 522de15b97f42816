"""Deals rows to weighted shards by rendezvous hashing of a stable key, and numbers the rows of each shard.

Every shard draws a number in (0, 1] from the hash of (shard, key); the shard of smallest ``-ln(draw) / weight`` takes
the row. A shard more takes rows only into itself, a shard less gives away only its own, and the rows of a shard are
proportional to its weight. All of it is column functions; texts are read once for size and checksum and not moved.

Slots: rows of a shard are put in cells by a second hash of the key, cells are numbered by a running count over the
small table of cell sizes, and rows are numbered inside their cell. Where keys repeat so often that a cell holds four times what
it should, its rows are spread over parts by their content and row; so no task sorts more than that. Slots of keys that do not
repeat depend on the keys and the number of rows alone, not on files.

Defined results: null text has no bytes (size 8, checksum 0). A null key hashes as the empty text. Repeated rows go
to the same shard and get slots of their own, in no given order among rows that are equal. Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics.plans.joins import attach
from panelytics.session import stage


@dataclass(frozen=True)
class Settings:
    weights: tuple[float, ...] = (1.0,) * 24
    grown: float = 1.0  # weight of one more shard
    cell_rows: int = 20_000


def draw(key: Column, shard: int) -> Column:
    """A number in (0, 1] from 52 bits of the MD5 of shard and key."""
    digest = F.md5(F.concat(F.lit(f"{shard}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / float(1 << 52)


def best_shards(key: Column, weights: list[float], grown: float) -> Column:
    """Struct of ``shard`` among all weights and ``more``, the shard with one more of weight ``grown``."""
    scores = [(-F.log(draw(key, i)) / float(w)) for i, w in enumerate([*weights, grown])]
    ranked = [F.struct(s.alias("score"), F.lit(i).alias("shard")) for i, s in enumerate(scores)]
    best = F.array_min(F.array(*ranked[:-1])) if len(weights) > 1 else ranked[0]
    return F.struct(best.alias("own"), ranked[-1].alias("more"))


def assign(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row of ``docs``."""
    if not settings.weights or min(*settings.weights, settings.grown) <= 0:
        raise ValueError("weights must be positive")
    text = F.coalesce("text", F.lit(""))
    best = best_shards(F.col("doc_id"), list(settings.weights), settings.grown)
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), best.alias("best"))
    own, more = F.col("best.own"), F.col("best.more")
    rows = rows.select("doc_id", "size", "text_crc32", own["shard"].alias("shard"), F.when(more < own, more["shard"]).otherwise(own["shard"]).alias("grown_shard"))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "dealt")
    cells = max(1, -(-rows.count() // (settings.cell_rows * len(settings.weights))))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)).cast("int"))
    parts = F.ceil(F.col("count") / F.lit(settings.cell_rows)).cast("int")
    heavy = rows.groupBy("shard", "cell").count().where(F.col("count") > 4 * settings.cell_rows).select("shard", "cell", parts.alias("parts"))
    # The row number that spreads rows of one key is fixed, as it is stored.
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "text_crc32", "row"), F.col("parts")), F.lit(0)).cast("int")
    rows = attach(rows, heavy, ["shard", "cell"], "left").withColumn("part", part).drop("parts")
    place = ["shard", "cell", "part"]
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(*place).count().select(*place, F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*place).orderBy("doc_id", "text_crc32", "row"))
    numbered = rows.withColumn("inside", inside)
    return numbered.join(offsets, place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("before") + F.col("inside") - 1).cast("long").alias("slot"),
        "grown_shard",
    )
