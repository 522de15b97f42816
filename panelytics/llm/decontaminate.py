"""Finds passages of benchmark items in whole texts, allowing for edits.

Texts and items are compared in lower case with every run of characters that are neither letters nor digits as one
blank. What counts as found, by the number of characters of an item:

* up to ``passage``: the whole item, with at most one edit in ``rate`` characters. It is split into one piece more than that;
  a text that holds it within the budget has at least one piece unchanged.
* more: any part of ``passage`` characters, wherever it begins, with at most ``passage // rate`` edits. The item is laid out in
  pieces so short that every such part holds one piece more than its budget.
* less than ``least``: the item itself, at word borders.

An Aho-Corasick automaton of all pieces finds the hits in one pass over the text. A hit of an item that is compared as a whole
is verified with its diagonal by Myers' bit-parallel distance to the best-fitting part of the text. A hit of a longer item
is first extended to both sides, as far as each number of edits allows, so that hits anywhere in a part find it; the part
is then verified by the same distance. Before that, one side must hold so many of the item's three-character grams as a
half of the part within the budget is sure to keep. Hits inside a stretch that has been extended already are passed over.

The items are read in blocks of at most ``block`` characters, so a benchmark of any size is a number of passes over the
documents, each with an automaton of bounded size. Documents are never shuffled.

Defined results: null texts and items are empty, and an empty item matches nothing. Repeated rows are judged alike, items of the
same text match alike, a null item_id stays null. The best match of an item is the smallest distance, then the first position.
Other columns do not matter.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelytics.llm.common import built, slices, texts
from panelytics.session import stage

OTHER = re.compile(r"[\W_]+")
# The same runs but for single blanks, which stay as they are.
UNLIKE_BLANK = re.compile(r"[\W_](?:[\W_]+|(?<! ))")


@dataclass(frozen=True)
class Settings:
    passage: int = 128
    rate: int = 12
    least: int = 40
    block: int = 4_000_000


def normalised(text: str) -> str:
    return UNLIKE_BLANK.sub(" ", text.lower()).strip()


def positions(text: str) -> list[int]:
    """For each character of ``normalised(text)`` the place in ``text`` that it comes from."""
    joined = text.lower()
    if len(joined) == len(text):  # no letter becomes shorter, so each has kept its length
        place = list(range(len(text)))
    else:  # a letter that depends on its neighbours keeps its length
        place = [i for i, c in enumerate(text) for _ in c.lower()]
    out, at = [], 0
    for m in OTHER.finditer(joined):
        out += place[at : m.start()]
        out.append(place[m.start()])
        at = m.end()
    out += place[at:]
    if joined and OTHER.match(joined):
        out = out[1:]
    if joined and OTHER.fullmatch(joined[-1]) and out:
        out = out[:-1]
    return out


def pieces(passage: str, budget: int) -> list[tuple[int, str]]:
    n = len(passage)
    edges = [n * i // (budget + 1) for i in range(budget + 2)]
    return [(a, passage[a:b]) for a, b in zip(edges, edges[1:], strict=False)]


def grid(item: str, passage: int, budget: int) -> list[tuple[int, str]]:
    """Pieces one after another, of which every part of ``passage`` characters holds ``budget + 1`` whole ones."""
    size = (passage + 1) // (budget + 2)
    starts = [*range(0, len(item) - size, size), len(item) - size]
    return [(s, item[s : s + size]) for s in starts]


def reach(own: str, text: str, budget: int) -> list[tuple[int, int]]:
    """For 0 to ``budget`` edits: how much of the beginning of ``own`` can be matched, and the length of its match in ``text``."""
    n, m = len(own), len(text)
    out: list[tuple[int, int]] = []
    row: dict[int, int] = {}
    for e in range(budget + 1):
        now: dict[int, int] = {}
        best = (0, 0)
        for k in range(-e, e + 1):
            # On diagonal k the text is k characters ahead: a change, a character of the text only, one of the item only.
            i = max(row.get(k, -2) + 1, row.get(k - 1, -1), row.get(k + 1, -2) + 1) if e else 0
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            while i < n and i + k < m and own[i] == text[i + k]:
                i += 1
            now[k] = i
            best = max(best, (i, i + k))
        row = now
        out.append(max(best, out[-1]) if out else best)
    return out


def same(own: str, text: str) -> int:
    """The length of the common beginning."""
    for i, (a, b) in enumerate(zip(own, text, strict=False)):
        if a != b:
            return i
    return min(len(own), len(text))


def grams(text: str) -> list[str]:
    return [text[i : i + 3] for i in range(len(text) - 2)]


def bits_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    return dict(masks)


class Matcher:
    """The items of one block and the automaton of their pieces."""

    def __init__(self, value: tuple[list[tuple[object, str]], Settings]) -> None:
        items, self.settings = value
        passage, rate, least = self.settings.passage, self.settings.rate, self.settings.least
        by_text: dict[str, list[int]] = defaultdict(list)
        self.ids = [i for i, _ in items]
        for at, (_, text) in enumerate(items):
            if own := normalised(text):
                by_text[own].append(at)
        self.texts = list(by_text)
        self.items = list(by_text.values())
        self.budgets = [0 if len(t) < least else min(len(t), passage) // rate for t in self.texts]
        self.masks = [bits_of(t) if least <= len(t) <= passage else {} for t in self.texts]
        self.halves: dict[str, tuple[list[str], list[str]]] = {}
        wanted: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, (t, budget) in enumerate(zip(self.texts, self.budgets, strict=True)):
            for start, piece in grid(t, passage, budget) if len(t) > passage else pieces(t, budget):
                wanted[piece].append((k, start))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in wanted.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def distance(self, m: int, masks: dict[str, int], text: str) -> tuple[int, int]:
        """Smallest edit distance between a pattern of m characters and a part of ``text``, and the end of the first such part."""
        full, high = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best, end = full, 0, m, m, 0
        for at, c in enumerate(text, 1):
            eq = masks.get(c, 0)
            zero = (((eq & plus) + plus) ^ plus) | eq | minus
            up = minus | ~(zero | plus) & full
            down = plus & zero
            if up & high:
                score += 1
            elif down & high:
                score -= 1
            up = up << 1 & full
            down = down << 1 & full
            plus = down | ~(zero | up) & full
            minus = up & zero
            if score < best:
                best, end = score, at
        return best, end

    def likely(self, k: int, own: str, text: str) -> bool:
        """Whether ``text`` keeps enough grams of the half of a part that ``own`` begins with; each edit takes three at most."""
        half = (self.settings.passage - (self.settings.passage + 1) // (self.budgets[k] + 2)) // 2
        need = half - 2 - 3 * self.budgets[k]
        if len(own) < half:
            return False
        own = own[:half]
        if own not in self.halves:
            if len(self.halves) >= 16_384:
                self.halves.clear()
            all_ = grams(own)
            cut = len(all_) * 2 // 3
            self.halves[own] = all_[:cut], all_[cut:]
        first, rest = self.halves[own]
        there = text[: half + self.budgets[k]]
        kept = sum([g in there for g in first])
        # Mostly the first grams tell already that the others are too few.
        return kept + len(rest) >= need and kept + sum([g in there for g in rest]) >= need

    def extended(self, k: int, start: int, size: int, text: str, at: int) -> tuple[tuple[int, int, int] | None, int]:
        """The best part of a long item around the piece at ``start`` that is found at ``at``, and the end of its exact stretch."""
        own, passage, budget = self.texts[k], self.settings.passage, self.budgets[k]
        room = min(start, passage)
        ahead, behind = own[start + size : start + size + passage], own[start - room : start][::-1]
        after, before = text[at + size : at + size + passage + budget], text[max(0, at - passage - budget) : at][::-1]
        i, j = same(behind, before), same(ahead, after)
        exact = at + size + j
        if i + size + j >= passage:
            return (0, at - i, exact), exact
        if not (self.likely(k, ahead, after) or self.likely(k, behind, before)):
            return None, exact
        right = reach(ahead, after, budget)
        if room + size + right[budget][0] < passage:
            return None, exact
        left = reach(behind, before, budget)
        for d in range(budget + 1):
            for e in range(d + 1):
                (i, x), (j, y) = left[e], right[d - e]
                if i + size + j >= passage:
                    part, low, high = own[start - i : start + size + j], at - x, at + size + y
                    return (self.distance(len(part), bits_of(part), text[low:high])[0], low, high), exact
        return None, exact

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best match of every item found in a normalised text."""
        seen: set[tuple[int, int]] = set()
        stretches: dict[tuple[int, int], int] = {}
        best: dict[int, tuple[int, int, int]] = {}
        if not len(self.automaton):
            return []
        passage, least = self.settings.passage, self.settings.least
        for end, (size, uses) in self.automaton.iter(text):
            at = end + 1 - size
            for k, start in uses:
                budget, n = self.budgets[k], len(self.texts[k])
                if n > passage:
                    if stretches.get((k, at - start), 0) > at:
                        continue
                    found, stretches[k, at - start] = self.extended(k, start, size, text, at)
                elif n < least:
                    bordered = (at == 0 or text[at - 1] == " ") and (end + 1 == len(text) or text[end + 1] == " ")
                    found = (0, at, end + 1) if bordered else None
                else:
                    # Windows of two neighbouring diagonals overlap by twice the budget, so none is missed.
                    low = (at - start) // (budget + 1) * (budget + 1)
                    if (k, low) in seen:
                        continue
                    seen.add((k, low))
                    a = max(0, low - budget)
                    d, to = self.distance(n, self.masks[k], text[a : low + n + 2 * budget + 1])
                    found = (d, max(0, a + to - n), a + to) if d <= budget else None
                if found:
                    for item in self.items[k]:
                        best[item] = min(best.get(item, found), found)
        return [(item, *found) for item, found in sorted(best.items())]


def item_blocks(items: DataFrame, settings: Settings) -> list[DataFrame]:
    """The items in blocks of about ``settings.block`` characters."""
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // settings.block))
    return [items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def _matched(rows: DataFrame, block: DataFrame, settings: Settings) -> DataFrame:
    """``rows`` (doc, text) with an array ``found`` of (item_id, distance, start, end) in the text as it is."""
    got = block.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").collect()
    sent = rows.sparkSession.sparkContext.broadcast(([(r[0], r[1]) for r in got], settings))
    item = block.schema["item_id"].dataType
    found = T.ArrayType(T.StructType([T.StructField("item_id", item), *(T.StructField(n, T.IntegerType()) for n in ("distance", "start", "end"))]))
    schema = T.StructType([rows.schema["doc"], T.StructField("found", found)])

    def run(batches):
        matcher = built("benchmark", sent, Matcher)
        for batch in slices(batches, "text"):
            out = []
            for raw in batch.column(1).cast(pa.string()).to_pylist():
                own = matcher.matches(normalised(raw))
                if own:
                    at = positions(raw)
                    own = [(matcher.ids[i], d, at[s], at[e - 1] + 1) for i, d, s, e in own]
                out.append([dict(zip(("item_id", "distance", "start", "end"), x, strict=True)) for x in own])
            kind = to_arrow_schema(schema).field("found").type
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc", "found"])

    return rows.mapInArrow(run, schema)


def _rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.select(F.struct(*columns).alias("doc"), texts(docs).alias("text"))


def matches(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, distance, start and end (characters of the text) of every item found in a row of ``docs``."""
    blocks = item_blocks(items, settings)
    out = []
    for block in blocks:
        one = _matched(_rows(docs, ["doc_id"]), block, settings).where(F.size("found") > 0)
        one = one.select("doc.doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")
        out.append(one if len(blocks) == 1 else stage(one, "matches"))
    joined = out[0]
    for other in out[1:]:
        joined = joined.unionByName(other)
    return joined


def drop_contaminated(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    for block in item_blocks(items, settings):
        rows = docs.select(F.struct(*docs.columns).alias("doc"), texts(docs).alias("text"))
        docs = _matched(rows, block, settings).where(F.size("found") == 0).select("doc.*")
    return docs
