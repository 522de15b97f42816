"""The manifest against a plain tree in Python, over several rounds of blocks."""

from __future__ import annotations

import zlib
from hashlib import sha256

import pytest

from panelytics.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, pos string, digest string, row int"


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row, text) -> str:
    return h(*(field(v) for v in (row[0], row[3], row[2], row[4], text)))


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(tree: list[list[str]], at: int, digest: str) -> tuple[str, str]:
    siblings = ""
    for level in tree[:-1]:
        run, slot = list(level[at // 8 * 8 : at // 8 * 8 + 8]), at % 8
        siblings += "".join(run[:slot] + run[slot + 1 :])
        run[slot], at = digest, at // 8
        digest = h(*run)
    return siblings, digest


def plain(rows) -> list[tuple]:
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees, owners = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        owners[lang], trees[lang] = own, levels([leaf(r, r[1]) for r in own])
    catalog = levels([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, r in enumerate(owners[lang]):
            tampered = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            text = r[1].encode().lower().decode() if tampered and r[1] is not None else r[1]
            inside, top = climb(trees[lang], at, leaf(r, text))
            outside, folded = climb(catalog, k, top)
            root = catalog[-1][0]
            out.append((r[0], leaf(r, r[1]), trees[lang][-1][0], root, h(inside + outside), folded, folded == root))
    return out


def key(rows):
    return sorted((str(r[0]), *map(str, r[1:])) for r in rows)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA)
    return [tuple(r) for r in merkle.audit(docs).collect()]


def edge_rows() -> list[tuple]:
    rows = [(i, f"Text {i} Ä {'B' * (i % 5)}", "en", "src0" if i % 3 else None, i) for i in range(150)]
    rows += [(7, None, None, None, None), (None, "Null Id", None, "s", 3), (None, "Null Id", None, "s", 3), (3, "", "", "s", 0)]
    rows += [(9, "Again", "en", "s", 1)] * 20 + [(11, "Alone", "zz", "s", 1), (12, "Ü" * 9, "é", "s", 1), (5, "X" * 300_000, "en", "s", 1)]
    return rows


def test_equals_a_plain_tree(spark):
    rows = edge_rows()
    assert key(found(spark, rows)) == key(plain(rows))


def test_more_rounds_than_one(spark, monkeypatch):
    """Blocks of eight, so that three rounds are needed below and two above."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = edge_rows() + [(1000 + i, "Own Tree", f"l{i:02d}", "s", 1) for i in range(20)]
    assert key(found(spark, rows)) == key(plain(rows))


@pytest.mark.parametrize("rows", [[], [(1, "One", "en", "s", 3)], [(i, "T", "en", "s", 1) for i in range(8)], [(i, "T", "en", "s", 1) for i in range(9)]])
def test_small_tables(spark, rows):
    assert key(found(spark, rows)) == key(plain(rows))


def test_a_parent_resumes_at_every_slot():
    children = [sha256(bytes([i])).digest() for i in range(8)]
    for n in range(1, 9):
        parent = merkle.Parent(children[:n])
        for slot in range(n):
            changed = [*children[:n]]
            changed[slot] = sha256(b"other").digest()
            assert parent.fold(slot, changed[slot]) == merkle.Parent(changed).digest
            assert parent.fold(slot, children[slot]) == parent.digest


def test_only_changed_texts_fail(spark):
    rows = [(i, "small" if i % 2 else "Big", "en", "s", 1) for i in range(300)]
    for doc_id, *_, verified in found(spark, rows):
        assert verified == (doc_id % 2 == 1 or zlib.crc32(str(doc_id).encode()) % 3 != 0)
