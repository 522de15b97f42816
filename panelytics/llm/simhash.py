"""SimHash fingerprints and the components of fingerprints within a few bits of each other.

* Fingerprints: one pass over the texts. A bit is set if over half of the shingle hashes have it; the hashes of a text
  are tallied as 256 counts for each of their eight bytes.
* Equal fingerprints are one node from here on, so copies never meet each other. Each node gets the keys of a two-level
  pigeonhole: of ``radius + 1`` parts one must be equal, and of ``radius + 1`` parts of the remaining bits another one.
  Nodes that share a key are compared. A key with more than ``tile`` nodes is spread over all pairs of its tiles.
* Comparison is bit-sliced: 64 fingerprints of a key are stored as 64 bit planes, a query is compared with all 64 by one
  exclusive-or a plane, distances are kept in two counter bits and an overflow bit by carry-save addition, and blocks
  whose 64 distances all exceed the radius are abandoned after every eight planes.
* A group sends on the edges of a spanning forest, never its pairs. Components come from rounds of large-star and
  small-star contraction, each written to the shared folder.

Defined results: null text is empty; a text without words has fingerprint zero and is linked like any other. Null ids
are ignored by ``min``: a component of null ids has a null id. Repeated rows are rows of the same component. Other
columns do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelytics.llm.common import slices, texts, words
from panelytics.session import stage

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
BITS = 64


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    own = words(text)
    if not own:
        return 0
    parts = map(b" ".join, zip(*(own[i:] for i in range(shingle)), strict=False)) if len(own) >= shingle else [b" ".join(own)]
    hashes = np.array([xxhash.xxh64_intdigest(p, seed) for p in parts], dtype="<u8")
    bytes_of = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.stack([np.bincount(bytes_of[:, k], minlength=256) for k in range(8)]) @ BYTE_BITS
    return int(np.packbits((2 * ones.reshape(-1) > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, carry: bool = False) -> DataFrame:
    """``doc``, a struct of the row's doc_id (all its columns with ``carry``), and fp, the 64 bits as a signed long."""

    def run(batches):
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc", "fp"])

    rows = docs.select(F.struct(*(docs.columns if carry else ["doc_id"])).alias("doc"), texts(docs).alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def _masks(bits: list[int], parts: int) -> list[int]:
    """Bit masks of ``parts`` parts of like size."""
    return [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def block_masks(radius: int) -> list[int]:
    """Masks such that two fingerprints within ``radius`` bits agree on all bits of at least one of them."""
    out = []
    for first in _masks(list(range(BITS)), radius + 1):
        rest = [b for b in range(BITS) if not first >> b & 1]
        out += [first | second for second in _masks(rest, radius + 1)]
    return out


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64 planes, words): bit j of word w of plane p is bit p of fingerprint 64 w + j; short of a word: zeros."""
    padded = np.zeros(-(-len(fps) // 64) * 64, dtype="<u8")
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")  # word, j, p
    packed = np.packbits(bits.transpose(2, 0, 1).reshape(BITS, -1), axis=1, bitorder="little")
    return np.ascontiguousarray(packed).view("<u8").reshape(BITS, -1)


def close_words(planes: np.ndarray, queries: np.ndarray, at: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Compares ``queries[i]`` with the 64 fingerprints of word ``at[i]``; only bits in ``valid[i]`` count.

    Returns the positions i with a hit and, for each, the word whose bits mark fingerprints within the radius.
    """
    if not 0 <= radius <= 3:
        raise ValueError("two counter bits hold radii up to 3")
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    live = np.arange(len(queries))
    over = ~valid
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    for p in range(BITS):
        mask = np.where(queries[live] >> np.uint64(p) & np.uint64(1), full, np.uint64(0))
        differ = planes[p][at[live]] ^ mask
        carry = ones & differ
        ones ^= differ
        over |= twos & carry  # the fourth difference
        twos ^= carry
        if p % 8 == 7:
            beyond = over if radius == 3 else over | (twos & ones) if radius == 2 else over | twos if radius == 1 else over | twos | ones
            keep = beyond != full
            if not keep.all():
                live, ones, twos, over = live[keep], ones[keep], twos[keep], over[keep]
            if not len(live):
                break
    beyond = over if radius == 3 else over | (twos & ones) if radius == 2 else over | twos if radius == 1 else over | twos | ones
    return live, ~beyond


def forest(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for all linked nodes but the roots; a root is the smallest node of its component."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, label[left], low)
        np.minimum.at(label, label[right], low)
        while True:
            short = label[label]
            if (short == label).all():
                break
            label = short
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def group_edges(groups: np.ndarray, fps: np.ndarray, radius: int, items: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (positions) among fingerprints of the same group; ``groups`` is sorted."""
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    sizes = np.diff(np.append(starts, len(groups)))
    keep = np.repeat(sizes > 1, sizes)
    place = np.flatnonzero(keep)
    if not len(place):
        return place, place
    sizes = sizes[sizes > 1]
    own_words = -(-sizes // 64)
    # Every group starts at a word of its own, so that a word never holds two groups.
    word_start = np.cumsum(own_words) - own_words
    group_of = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot = word_start[group_of] * 64 + inside
    padded = np.zeros(int(own_words.sum()) * 64, dtype=np.uint64)
    padded[slot] = fps[place]
    planes = bit_planes(padded)
    where = np.full(len(padded), -1)
    where[slot] = np.arange(len(place))
    bits = np.packbits((where >= 0).astype(np.uint8).reshape(-1, 64), axis=1, bitorder="little")
    filled = np.ascontiguousarray(bits).view("<u8").reshape(-1)
    # A query meets the words of its group from its own on; in its own, only the fingerprints after it.
    own_word = slot // 64
    meets = (word_start + own_words)[group_of] - own_word
    left, right = np.arange(0), np.arange(0)
    ends = np.cumsum(meets)
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + items, side="right")))
        query = np.repeat(np.arange(at, to), meets[at:to])
        step = np.arange(len(query)) - np.repeat(np.cumsum(meets[at:to]) - meets[at:to], meets[at:to])
        word = own_word[query] + step
        j = (slot[query] % 64).astype(np.uint64)
        later = np.where(step == 0, ~((np.uint64(2) << j) - np.uint64(1)), np.uint64(0xFFFFFFFFFFFFFFFF))
        row, hits = close_words(planes, padded[slot[query]], word, filled[word] & later, radius)
        if len(row):
            found = np.unpackbits(np.ascontiguousarray(hits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, b = np.nonzero(found)
            left, right = forest(len(place), np.concatenate([left, query[row[i]]]), np.concatenate([right, where[word[row[i]] * 64 + b]]))
        at = to
    return place[left], place[right]


def near_edges(nodes: DataFrame, radius: int, tile: int = 4_096) -> DataFrame:
    """(a, b): edges with the components of all links within ``radius`` bits among the distinct ``nodes.fp``.

    Each group of a key sends on a star for each of its components, so an edge need not be a link itself.
    """
    masks = [m - (1 << BITS) if m >> (BITS - 1) else m for m in block_masks(radius)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks)]))
    keyed = nodes.select("fp", keys.alias("k")).select("fp", "k.block", "k.part")
    sizes = keyed.groupBy("block", "part").count()
    shared = sizes.where("count > 1").select("block", "part", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    # A node of tile t goes to the pairs (t, u) and (u, t); with one tile that is one row.
    tiled = keyed.join(shared, ["block", "part"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda u: F.struct(F.least("own", u).alias("t"), F.greatest("own", u).alias("u")))
    dealt = tiled.withColumn("x", F.explode(pairs)).select("fp", "block", "part", F.col("x.t").alias("t"), F.col("x.u").alias("u"))
    cell = F.xxhash64("block", "part", "t", "u").alias("cell")  # two keys in one cell only compare more

    def compare(batches):
        held_group, held_fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

        def edges(groups, fps):
            a, b = group_edges(groups, fps, radius)
            return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], ["a", "b"])

        for batch in batches:
            group = np.concatenate([held_group, batch.column(0).to_numpy()])
            fps = np.concatenate([held_fp, batch.column(1).to_numpy().view(np.uint64)])
            # The last group may go on in the next batch.
            cut = int(np.searchsorted(group, group[-1], side="left")) if len(group) else 0
            if cut:
                yield edges(group[:cut], fps[:cut])
            held_group, held_fp = group[cut:], fps[cut:]
        if len(held_group) > 1:
            yield edges(held_group, held_fp)

    sorted_cells = dealt.select(cell, "fp").repartition("cell").sortWithinPartitions("cell")
    return sorted_cells.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node reachable.

    Large star: the larger neighbours of a node are linked to the smallest node around it. Small star: a node and its
    smaller neighbours are linked to the smallest of them. Both keep components; they end with one star for each.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        # u's neighbourhood as rows (u, v); the small star looks only at smaller neighbours.
        around = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = around.join(least, "a")
        to = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        return to.where("a <> b").distinct()

    def settled(links: DataFrame) -> bool:
        """Every node is either a leaf with one link or a centre: the links are a star for each component."""
        ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            links.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
        )
        sums = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        return sums.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()

    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    done = 0
    while not settled(links):
        if done == rounds:
            raise RuntimeError("components did not settle")
        links, done = stage(star(star(links, True), False), "links"), done + 1
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def component_roots(nodes: DataFrame, radius: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``nodes``; ``root`` is the smallest fingerprint of its component."""
    linked = components(near_edges(nodes.select("fp"), radius)).withColumnRenamed("node", "fp")
    return nodes.select("fp").join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links) for every row of ``docs``."""
    marked = stage(fingerprints(docs, shingle, seed).select("doc.doc_id", "fp"), "fingerprints")
    nodes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    rooted = component_roots(nodes, radius).join(nodes, "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(named, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` but all near copies: of each component the row of smallest doc_id stays (null ids last)."""
    marked = fingerprints(docs, shingle, seed, carry=True).withColumn("row", F.monotonically_increasing_id())
    marked = stage(marked, "fingerprinted")
    rank = F.struct(F.col("doc.doc_id").isNull().alias("none"), F.col("doc.doc_id").alias("id"), F.col("row").alias("row"))
    nodes = stage(marked.groupBy("fp").agg(F.min(rank).alias("least")), "nodes")
    rooted = component_roots(nodes, radius).join(nodes, "fp")
    stays = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row").alias("row"))
    return marked.join(stays, "row", "left_semi").select("doc.*")


def hexadecimal(column: str = "fp"):
    """16 lower-case hexadecimal digits of the 64 bits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
