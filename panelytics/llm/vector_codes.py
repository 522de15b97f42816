"""Compresses vectors to one code for each of their parts, in whole numbers from end to end.

Components become ``floor(scale * x)``. A vector is cut into parts, each part has a codebook, and some rounds of assigning
and averaging move its entries. Distances are taken after an integer Walsh-Hadamard transform of the zero-padded part and
entry: the transform of width P multiplies every squared distance by P exactly, and in sequency order (by number of sign
changes) the first coefficients hold most of it. So squared differences are summed coefficient by coefficient, entries
whose sum exceeds the whole distance of a likely entry are out, and what is left is compared in full. Nothing is rounded
and ties go to the lower index, so the result is that of comparing everything with everything.

Rounds are passes over stored whole numbers: every task sums its own rows by entry, Spark adds these sums, and the driver
holds the codebooks, which are entries x dimension numbers at any size of the table.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. Scaled components beyond
2^62 count as 2^62, and errors beyond the largest long as that. Sums that 64 bits might not hold are made with Python's
own integers. The width is that of the first kept row in the order of vec_id (null last), then components; rows of another
width cannot be compared and are dropped. A width that the number of parts does not divide is filled up with zeros. With
fewer rows than entries the codebooks start with what there is. Repeated rows count as often as they occur. Null labels
are one label. An empty table has no row. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.llm.common import built
from panelytics.plans.joins import attach
from panelytics.session import stage

LARGEST = (1 << 63) - 1
CHUNK = 256  # rows compared at once


@dataclass(frozen=True)
class Settings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024


# --- distances inside tasks -------------------------------------------------------------------------------------------


def sequency(width: int) -> np.ndarray:
    """Rows of the Hadamard matrix of this width (a power of two) by number of sign changes."""
    signs = walsh(np.eye(width, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def walsh(rows: np.ndarray) -> np.ndarray:
    """Integer Walsh-Hadamard transform of every row, in natural order, without scaling."""
    count, width = rows.shape
    half = 1
    while half < width:
        pairs = rows.reshape(count, width // (2 * half), 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        rows = np.stack([a + b, a - b], axis=2).reshape(count, width)
        half *= 2
    return rows


def padded(rows: np.ndarray) -> np.ndarray:
    width = 1 << max(0, rows.shape[1] - 1).bit_length()
    # Zeros of the same kind: np.pad would put 64-bit numbers among Python's.
    return np.concatenate([rows, np.zeros((len(rows), width - rows.shape[1]), dtype=rows.dtype)], axis=1)


def exact(rows: np.ndarray, *others: np.ndarray) -> np.dtype:
    """The narrowest numbers that scaled squared distances are sure to fit: 32 bits, 64, or Python's.

    With P coefficients and components of L at most, the squares of all coefficients of a difference add up to P times its
    squared length, which is P (2 L)^2 at most; no part of the sum and no coefficient exceeds that.
    """
    largest = max((int(abs(int(m))) for r in (rows, *others) if r.size for m in (r.min(), r.max())), default=0)
    width = 1 << max(0, rows.shape[1] - 1).bit_length()
    most = (2 * width * largest) ** 2
    return np.dtype(np.int32) if most < 1 << 31 else np.dtype(np.int64) if most < 1 << 62 else np.dtype(object)


def nearest(rows: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (lowest among equals) and the squared distance to it, for every row."""
    kind = exact(rows, entries)
    order = sequency(1 << max(0, rows.shape[1] - 1).bit_length())
    rows, entries = (walsh(padded(x.astype(kind)))[:, order] for x in (rows, entries))
    width, step = len(order), max(1, len(order) // 8)
    columns = np.ascontiguousarray(entries.T)
    index, distance = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=object if kind == object else np.int64)
    for low in range(0, len(rows), CHUNK):
        x = rows[low : low + CHUNK]
        sums, done, bound = np.zeros((len(x), len(entries)), dtype=kind), 0, None
        while done < width:
            for c in range(done, min(width, done + step)):
                apart = x[:, c, None] - columns[c]
                sums += apart * apart
            done = min(width, done + step)
            if done * 4 >= width:
                # The whole distance of the entry that leads so far is one that the nearest entry cannot exceed.
                likely = ((x - entries[sums.argmin(axis=1)]) ** 2).sum(axis=1)
                bound = likely if bound is None else np.minimum(bound, likely)
                left = sums <= bound[:, None]
                if done < width and left.sum() * 4 <= left.size:
                    break
        at, entry = np.nonzero(sums <= bound[:, None])
        sums = sums[at, entry]
        while done < width:
            apart = x[at, done : done + step] - entries[entry, done : done + step]
            sums = sums + (apart * apart).sum(axis=1)
            done += step
            left = sums <= bound[at]
            at, entry, sums = at[left], entry[left], sums[left]
        starts = np.searchsorted(at, np.arange(len(x)))
        best = np.minimum.reduceat(sums, starts)
        hit = np.flatnonzero(sums == best[at])
        first = hit[np.searchsorted(at[hit], np.arange(len(x)))]
        index[low : low + CHUNK], distance[low : low + CHUNK] = entry[first], best // width
    return index, distance


def matrix(batch: pa.RecordBatch, column: str, parts: int) -> np.ndarray:
    """Rows x parts x width of a part, filled up with zeros."""
    values = batch.column(column)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(batch.num_rows, -1) if len(flat) else np.zeros((batch.num_rows, 0), dtype=np.int64)
    return in_parts(rows, parts)


def in_parts(rows: np.ndarray, parts: int) -> np.ndarray:
    width = -(-rows.shape[1] // parts)
    return np.pad(rows, ((0, 0), (0, parts * width - rows.shape[1]))).reshape(len(rows), parts, width)


def exact_sums(rows: np.ndarray, index: np.ndarray, entries: int) -> np.ndarray:
    """Sums of the rows by index; Python's integers where 64 bits might not hold them."""
    largest = max(abs(int(rows.min())), abs(int(rows.max()))) if rows.size else 0
    sums = np.zeros((entries, rows.shape[1]), dtype=np.int64 if largest * len(rows) < 1 << 62 else object)
    np.add.at(sums, index, rows.astype(sums.dtype))
    return sums


# --- codebooks --------------------------------------------------------------------------------------------------------


def whole_numbers(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Stored vec_id, label and the scaled components (array of long) of the rows that take part."""
    most = float(1 << 62)
    fit = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    scaled = F.transform("embedding", lambda x: F.floor(F.greatest(F.lit(-most), F.least(F.lit(most), x.cast("double") * float(settings.scale)))).cast("long"))
    rows = vectors.where(F.col("embedding").isNotNull() & fit).select("vec_id", "label", scaled.alias("whole"))
    rows = stage(rows, "whole")
    first = leading(rows, 1)
    return rows.where(F.size("whole") == len(first[0])) if first else rows


def leading(rows: DataFrame, count: int) -> list[list[int]]:
    """Components of the first rows by vec_id, null last."""
    return [r["whole"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(count).collect()]


def nearest_parts(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    parts = matrix(batch, "whole", len(books))
    found = [nearest(parts[:, p], books[p]) for p in range(len(books))]
    return parts, [f[0] for f in found], [f[1] for f in found]


def sums_of(rows: DataFrame, books: Broadcast) -> DataFrame:
    """(part, entry, pos, high, low, rows) by task: high * 2^32 + low is the sum of the component over the entry's parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = built("codebooks", books, np.asarray)
        shape, total, counts = own.shape, 0, np.zeros(own.shape[:2], dtype=np.int64)
        for batch in batches:
            parts, index, _ = nearest_parts(batch, own)
            total = total + np.stack([exact_sums(parts[:, p], index[p], shape[1]) for p in range(shape[0])]).astype(object)
            counts += np.stack([np.bincount(i, minlength=shape[1]) for i in index])
        part, entry = np.nonzero(counts)
        # One more place, of sum zero, so that entries of no width are counted too.
        sums = np.concatenate([np.zeros((len(part), 1), dtype=object), total[part, entry] if len(part) else np.zeros((0, shape[2]), dtype=object)], axis=1)
        places = sums.shape[1]
        columns = [np.repeat(part, places), np.repeat(entry, places), np.tile(np.arange(places) - 1, len(part))]
        high, low = [np.array([f(s) for s in sums.ravel()], dtype=np.int64) for f in (lambda s: s >> 32, lambda s: s & 0xFFFFFFFF)]
        columns += [high, low, np.repeat(counts[part, entry], places)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["part", "entry", "pos", "high", "low", "rows"])

    summed = rows.select("whole").mapInArrow(run, "part long, entry long, pos long, high long, low long, rows long")
    return summed.groupBy("part", "entry", "pos").agg(*(F.sum(c).alias(c) for c in ("high", "low", "rows")))


def train(rows: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """Codebooks (parts x entries x width) after all rounds over what ``whole_numbers`` returns."""
    start = leading(rows, settings.entries)
    width = len(start[0]) if start else 0
    books = in_parts(np.array(start, dtype=np.int64).reshape(len(start), width), settings.parts).transpose(1, 0, 2).copy()
    context = rows.sparkSession.sparkContext
    for _ in range(settings.rounds if len(start) else 0):
        sent = context.broadcast(books.copy())
        for r in sums_of(rows, sent).collect():  # entries x width rows, whatever the table's size
            if r["pos"] >= 0:
                books[r["part"], r["entry"], r["pos"]] = ((r["high"] << 32) + r["low"]) // r["rows"]
        sent.unpersist()
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, codes (one index for each part) and error (sum of the squared distances)."""
    sent = rows.sparkSession.sparkContext.broadcast(books.copy())
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = built("codebooks", sent, np.asarray)
        for batch in batches:
            if batch.num_rows:
                _, index, apart = nearest_parts(batch, own)
                codes = pa.array(list(np.stack(index, axis=1).astype(np.int32)), pa.list_(pa.int32()))
                error = [min(LARGEST, sum(map(int, a))) for a in zip(*apart, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(error, pa.int64())], ["vec_id", "label", "codes", "error"])

    shape = f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long"
    return rows.select("vec_id", "label", "whole").mapInArrow(run, shape)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """vec_id, code (two hexadecimal digits a part), error, label_error (over equal labels) and codebooks_sha256."""
    rows = whole_numbers(vectors, settings)
    books = train(rows, settings)
    coded = stage(encode(rows, books), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    own = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    named = coded.select("vec_id", "codes", "error", own.alias("own"))
    labels = named.groupBy("own").agg(total.alias("label_error"))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return attach(named, labels, ["own"]).select(
        "vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def compress_sql(settings: Settings = Settings()) -> str:
    """DuckDB SQL for ``compress`` over ``embeddings``: every part against every entry, in whole numbers."""
    w = f"(len(whole) // {settings.parts})"
    assign = """
a{i} AS (
  SELECT id, part, v, min(struct_pack(d := d, entry := entry)) AS best FROM (
    SELECT p.id, p.part, p.v, b.entry, CAST(list_sum(list_transform(list_zip(p.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
    FROM parts p JOIN b{i} b ON b.part = p.part)
  GROUP BY id, part, v)"""
    update = """
s{i} AS (
  SELECT part, entry, list(CAST(floor_sum AS BIGINT) ORDER BY pos) AS c FROM (
    SELECT part, best.entry AS entry, pos, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS floor_sum
    FROM (SELECT part, best, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) GROUP BY part, best.entry, pos)
  GROUP BY part, entry),
b{n} AS (SELECT b.part, b.entry, coalesce(s.c, b.c) AS c FROM b{i} b LEFT JOIN s{i} s ON s.part = b.part AND s.entry = b.entry)"""
    passes = ",".join((assign + "," + update).format(i=i, n=i + 1) for i in range(settings.rounds))
    return f"""WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS id, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {settings.scale}) AS BIGINT)) AS whole
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS (
  SELECT id, part, whole[part * {w} + 1:(part + 1) * {w}] AS v FROM kept, (SELECT unnest(range({settings.parts})) AS part)),
b0 AS (SELECT part, id AS entry, v AS c FROM parts WHERE id < {settings.entries}),{passes},{assign.format(i=settings.rounds)},
coded AS (
  SELECT k.vec_id, k.label, string_agg(lpad(lower(to_hex(a.best.entry)), 2, '0'), '' ORDER BY a.part) AS code, CAST(sum(a.best.d) AS BIGINT) AS error
  FROM a{settings.rounds} a JOIN kept k USING (id) GROUP BY k.id, k.vec_id, k.label),
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{settings.rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest"""
