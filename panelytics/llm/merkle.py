"""A Merkle manifest of documents: a tree of eights for every language, and one over their roots.

Parents retain what folding needs: a copy of their hash state from before each child's slot. To fold a replaced child, the
state of its slot is copied, takes the replacement and the children to its right, and yields the parent; nothing to the
left is hashed again.

Nodes are told by (tree, pos). The tree is cut into blocks of 4,096 nodes in a row, which are four levels. On the way up
a block is one group of a shuffle and yields one digest; the digests are the nodes of the next round, so a table of 10^10
rows takes three rounds. On the way down every block meets the one row of its path (the runs of eight above it), retains
the parents of its four levels and of that path, and hands the path on to its children, or folds them. So a group holds
4,096 rows and a path of some dozen runs, whatever share of the table one language or one document id holds. Places of
leaves come from a range partitioning of the order itself and a running count over its partitions.

Defined results: a null language is a tree of its own, before all others; the empty language is another one. Null ids come
first and count as the empty text in the trial's choice of rows. Rows of one id are ordered by their leaf, and rows that
are equal in everything have equal leaves, so their order does not show. Nulls hash as ``-``, the empty text as ``0:``.
An empty table has no row. Other columns do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelytics.llm.common import id_remainder
from panelytics.plans.joins import attach
from panelytics.session import stage

FANOUT = 8
LEVELS = 4  # of one block
BLOCK = FANOUT**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<slot: int, run: array<binary>>>"
PATH = f"path {STEPS}, subroot binary, root binary"


class Parent:
    """The hash of a run of children, with a copy of its state from before every child."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]) -> None:
        state, self.children, self.states = sha256(), [c.hex().encode() for c in children], []
        for child in self.children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.digest()

    def fold(self, slot: int, replacement: bytes) -> bytes:
        """The parent's digest with another child in ``slot``."""
        state = self.states[slot].copy()
        state.update(replacement.hex().encode() + b"".join(self.children[slot + 1 :]))
        return state.digest()

    def siblings(self, slot: int) -> bytes:
        return b"".join(self.children[:slot] + self.children[slot + 1 :])


def climb(digests: list[bytes], levels: int) -> list[list[Parent]]:
    """Parents of each level over a block's nodes."""
    rows = []
    for _ in range(levels):
        rows.append([Parent(digests[i : i + FANOUT]) for i in range(0, len(digests), FANOUT)])
        digests = [p.digest for p in rows[-1]]
    return rows


def steps(rows: list[list[Parent]], at: int) -> list[tuple[int, Parent]]:
    """Slot and parent of a block's node ``at``, level by level."""
    path = []
    for parents in rows:
        at, slot = divmod(at, FANOUT)
        path.append((slot, parents[at]))
    return path


def field(name: str, own: Column | None = None) -> Column:
    text = (F.col(name) if own is None else own).cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Stored rows of tree, doc_id, digest and ``offered``: the leaf as handed in for the check.

    ``tampered`` tells rows that are handed in with the A-Z of their text lower-cased; the others are handed in unchanged.
    """
    head = [field(c) for c in ("doc_id", "source", "lang", "n_chars")]
    whole = F.unhex(F.sha2(F.concat(*head, field("text")).cast("binary"), 256))
    lowered = F.unhex(F.sha2(F.concat(*head, field("text", F.translate("text", UPPER, LOWER))).cast("binary"), 256))
    tree = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    offered = whole if tampered is None else F.when(tampered, lowered).otherwise(whole)
    rows = docs.select(tree.alias("tree"), "doc_id", whole.alias("digest"), offered.alias("offered"))
    return stage(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")


def place(items: DataFrame, *order: str) -> DataFrame:
    """``items`` with ``pos``, their place in their tree by ``order``, and ``depth``, the tree's number of levels."""
    ranged = items.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ranged = stage(ranged.withColumn("at", F.monotonically_increasing_id()), "ranged").withColumn("cut", F.shiftright("at", 33))
    cuts = ranged.groupBy("tree", "cut").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = F.sum("rows").over(tree.orderBy("cut").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    total = F.sum("rows").over(tree)
    depth = sum((total > F.lit(FANOUT**k)).cast("int") for k in range(21))
    cuts = cuts.select("tree", "cut", (F.col("first") - before).alias("shift"), depth.alias("depth"))
    return attach(ranged, cuts, ["tree", "cut"]).withColumn("pos", F.col("at") - F.col("shift")).drop("at", "cut", "shift", *order)


def blocks(nodes: DataFrame, of: int) -> DataFrame:
    """Nodes of round ``of`` with their block and the number of levels that their tree has in this round."""
    levels = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.col("depth") - of * LEVELS))
    return nodes.withColumn("block", F.expr(f"pos div {BLOCK}")).withColumn("levels", levels)


def climb_blocks(nodes: DataFrame, of: int) -> DataFrame:
    """One node for every block: the nodes of the next round."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        levels = group["levels"][0].as_py()
        digests = group["digest"].to_pylist()
        top = climb(digests, levels)[-1][0].digest if levels else digests[0]
        return pa.table([group["tree"][:1], group["block"][:1], group["depth"][:1], pa.array([top], pa.binary())], ["tree", "pos", "depth", "digest"])

    rows = blocks(nodes, of).select("tree", "block", "pos", "depth", "levels", "digest")
    return rows.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, depth int, digest binary")


def upper_steps(paths: pa.Table) -> list[tuple[int, Parent]]:
    return [(step["slot"], Parent(step["run"])) for step in paths["path"][0].as_py()]


def descend(nodes: DataFrame, of: int, paths: DataFrame) -> DataFrame:
    """The path of every node of round ``of``, from the paths of the blocks they are in."""
    names = ["tree", "pos", "path", "subroot", "root"]
    kinds = pa.list_(pa.struct([("slot", pa.int32()), ("run", pa.list_(pa.binary()))]))

    def run(group: pa.Table, path: pa.Table) -> pa.Table:
        group, above = group.sort_by("pos"), path["path"][0].as_py()
        rows = climb(group["digest"].to_pylist(), group["levels"][0].as_py())
        own = [[{"slot": s, "run": [bytes.fromhex(c.decode()) for c in p.children]} for s, p in steps(rows, i)] + above for i in range(group.num_rows)]
        ends = [pa.array(path[c].to_pylist() * group.num_rows, pa.binary()) for c in names[3:]]
        return pa.table([group["tree"], group["pos"], pa.array(own, kinds), *ends], names)

    below = blocks(nodes, of).select("tree", "block", "pos", "levels", "digest").groupBy("tree", "block")
    return below.cogroup(paths.groupBy("tree", "pos")).applyInArrow(run, f"tree string, pos long, {PATH}")


def fold_blocks(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (the digest of all siblings) and folded (the root from ``offered``) of every leaf."""
    names = ["doc_id", "leaf", "subroot", "root", "proof", "folded"]

    def run(group: pa.Table, path: pa.Table) -> pa.Table:
        group, above = group.sort_by("pos"), upper_steps(path)
        leaf = group["digest"].to_pylist()
        rows = climb(leaf, group["levels"][0].as_py())
        proofs, folded = [], []
        for i, digest in enumerate(group["offered"].to_pylist()):
            proof = sha256()
            for slot, parent in steps(rows, i) + above:
                proof.update(parent.siblings(slot))
                digest = parent.fold(slot, digest)
            proofs.append(proof.digest())
            folded.append(digest)
        ends = [path[c].to_pylist() * len(leaf) for c in names[2:4]]
        return pa.table([group["doc_id"], *(pa.array(c, pa.binary()) for c in (leaf, *ends, proofs, folded))], names)

    kind = nodes.schema["doc_id"].dataType.simpleString()
    below = blocks(nodes, 0).select("tree", "block", "pos", "levels", "doc_id", "digest", "offered").groupBy("tree", "block")
    digests = ", ".join(f"{n} binary" for n in names[1:])
    return below.cogroup(paths.groupBy("tree", "pos")).applyInArrow(run, f"doc_id {kind}, {digests}")


def rounds(leaf_nodes: DataFrame) -> list[DataFrame]:
    """Nodes of every fourth level; the last frame holds one node for each tree."""
    nodes = [leaf_nodes]
    deepest = leaf_nodes.agg(F.max("depth")).first()[0] or 0
    for of in range(max(1, -(-deepest // LEVELS))):
        nodes.append(stage(climb_blocks(nodes[-1], of), "nodes"))
    return nodes


@dataclass(frozen=True)
class Manifest:
    """Stored nodes of the trees of all languages, and of the one tree over their roots."""

    trees: list[DataFrame]  # (tree, pos, depth, digest); the first with doc_id and offered, the last holds the subroots
    catalog: list[DataFrame]  # the same over the subroots; the last holds the root


def build(leaf_rows: DataFrame) -> Manifest:
    trees = rounds(place_leaves(leaf_rows))
    subroots = trees[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    catalog = rounds(place(subroots.withColumn("by", F.col("name")), "by"))
    return Manifest(trees, catalog)


def place_leaves(leaf_rows: DataFrame) -> DataFrame:
    """Leaves by doc_id; by their digest and their stored row number where ids repeat."""
    return place(leaf_rows.withColumns({"by": F.col("doc_id"), "then": F.col("digest"), "last": F.col("row")}).drop("row"), "by", "then", "last")


def proofs(manifest: Manifest) -> DataFrame:
    """What ``fold_blocks`` returns, for every leaf of the manifest."""
    *lower, top = manifest.catalog
    paths = top.select("tree", "pos", F.array().cast(STEPS).alias("path"), F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    for of in reversed(range(len(lower))):
        paths = descend(lower[of], of, paths)
    names = lower[0].select("pos", "name", F.col("digest").alias("own"))
    paths = names.join(paths, "pos").select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("own").alias("subroot"), "root")
    *lower, _ = manifest.trees
    for of in reversed(range(1, len(lower))):
        paths = stage(descend(lower[of], of, paths), "paths")
    return fold_blocks(lower[0], paths)


def digests(found: DataFrame) -> DataFrame:
    """``proofs`` in hexadecimal, with ``verified``: the folded root is the root."""
    shown = {"leaf": "leaf", "subroot": "subroot", "root": "root", "proof": "proof_sha256", "folded": "folded_root"}
    return found.select("doc_id", *(F.lower(F.hex(c)).alias(n) for c, n in shown.items()), (F.col("folded") == F.col("root")).alias("verified"))


def audit(docs: DataFrame) -> DataFrame:
    """The manifest's trial: every row is folded back, a third of the ids with a text that was tampered with."""
    return digests(proofs(build(leaves(docs, id_remainder("doc_id", 3) == 0))))


def audit_sql() -> str:
    """DuckDB SQL for ``audit`` over ``documents``."""

    def part(name: str, text: str | None = None) -> str:
        text = text or f"CAST({name} AS VARCHAR)"
        return f"CASE WHEN {name} IS NULL THEN '-' ELSE strlen({text}) || ':' || {text} END"

    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    lowered = part("text", f"translate(text, '{UPPER}', '{LOWER}')")

    def tree(name: str, start: str) -> str:
        """Nodes of all levels of trees k, runs of children, and the number of levels."""
        return f"""{name} AS (
  {start}
  UNION ALL
  SELECT k, lvl + 1, pos // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY pos))
  FROM {name} WHERE n > 1 GROUP BY k, lvl, n, pos // {FANOUT}),
{name}_runs AS (SELECT k, lvl, pos // {FANOUT} AS run, list(digest ORDER BY pos) AS ds FROM {name} WHERE n > 1 GROUP BY k, lvl, pos // {FANOUT}),
{name}_tops AS (SELECT k, lvl, digest FROM {name} WHERE n = 1)"""

    def fold(name: str, nodes: str, start: str) -> str:
        left, right = f"array_to_string(ds[1:pos % {FANOUT}], '')", f"array_to_string(ds[pos % {FANOUT} + 2:], '')"
        return f"""{name} AS (
  {start}
  UNION ALL
  SELECT f.id, f.k, f.lvl + 1, f.pos // {FANOUT}, sha256({left} || f.digest || {right}), f.proof || {left} || {right}
  FROM {name} f JOIN {nodes}_runs r ON r.k = f.k AND r.lvl = f.lvl AND r.run = f.pos // {FANOUT}),
{name}_ends AS (SELECT f.* FROM {name} f JOIN {nodes}_tops t ON t.k = f.k AND t.lvl = f.lvl)"""

    return f"""WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)),
    lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
chosen AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''),
    lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]))) % 3 = 0 AS tampered
  FROM documents, crc),
leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS k, sha256({head} || {part("text")}) AS digest,
    CASE WHEN tampered THEN sha256({head} || {lowered}) ELSE sha256({head} || {part("text")}) END AS offered
  FROM chosen),
placed AS (
  SELECT row_number() OVER () AS id, *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
    count(*) OVER (PARTITION BY k) AS n
  FROM leaf),
{tree("trees", "SELECT k, 0 AS lvl, pos, n, digest FROM placed")},
subroots AS (SELECT k AS name, digest, row_number() OVER (ORDER BY encode(k)) - 1 AS pos, count(*) OVER () AS n FROM trees_tops),
{tree("catalog", "SELECT '' AS k, 0 AS lvl, pos, n, digest FROM subroots")},
{fold("inner_fold", "trees", "SELECT id, k, 0 AS lvl, pos, offered AS digest, '' AS proof FROM placed")},
{fold("outer_fold", "catalog", "SELECT f.id, '' AS k, 0 AS lvl, s.pos, f.digest, f.proof FROM inner_fold_ends f JOIN subroots s ON s.name = f.k")}
SELECT p.doc_id, p.digest AS leaf, s.digest AS subroot, c.digest AS root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
  f.digest = c.digest AS verified
FROM placed p JOIN outer_fold_ends f ON f.id = p.id JOIN subroots s ON s.name = p.k CROSS JOIN catalog_tops c"""
