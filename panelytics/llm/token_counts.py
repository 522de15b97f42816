"""Counts tokens of whole texts under a byte-level BPE vocabulary without making ids.

A text's words are the initial symbols of its bytes minus the merges made: the adjacent pair of lowest rank is popped
from a heap, its two symbols of a linked list become one, and the pairs on both sides of it are pushed, until no pair
has a rank. Counts of words, and of words with the blanks before them,
are kept in each worker, at most ``keep`` of either, so a frequent word is merged once.

Texts are cut where a character that is no white space meets white space: no token of the pattern below crosses from the
first to the second. The string of an added special token counts as one token and cuts the text, as the library does
by default (no stripping, case as written).

Defined results: null text is empty, 0 tokens. Rows are counted one by one, repeated rows alike; other columns do not
matter. A word of any length is merged in O(n log n).
"""

from __future__ import annotations

import heapq
import json
import re

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.llm.common import slices, texts

# The pre-tokenisation pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: White space, or what some call so, outside the six ASCII blanks; such texts are cut by the pattern alone.
OTHER_SPACE = re.compile(r"[^\S \t-\r]")
_COUNTERS: dict[str, "MergeCounter"] = {}


def byte_characters() -> dict[int, str]:
    """The printable character by which the vocabulary writes each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class MergeCounter(dict):
    """Token counts by chunk; a chunk not yet met is merged when it is looked up."""

    def __init__(self, path: str, keep: int = 400_000, longest: int = 100) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or spec["normalizer"]:
            raise ValueError("not a plain byte-level BPE vocabulary")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that change their surroundings are not known here")
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        # Symbols are numbers; a pair is one number, and its rank says which symbol it becomes.
        ids = spec["model"]["vocab"]
        self.shift = len(ids).bit_length()
        self.ranks = {ids[a] << self.shift | ids[b]: i for i, (a, b) in enumerate(merges)}
        self.becomes = [ids[a + b] for a, b in merges]
        chars = byte_characters()
        self.bytes = [ids[chars[b]] for b in range(256)]
        self.words: dict[str, int] = {}
        self.pattern = regex.compile(PATTERN)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.keep, self.longest = keep, longest

    def merged(self, word: str) -> int:
        """Symbols left of one word after all merges."""
        code, shift, rank_of, becomes = self.bytes, self.shift, self.ranks.get, self.becomes
        symbols = [code[b] for b in word.encode()]
        n = left = len(symbols)
        heap = [r * n + i for i in range(n - 1) if (r := rank_of(symbols[i] << shift | symbols[i + 1])) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        # after[i] is the next symbol's place, before[i] the last one's; a merged-away symbol is -1.
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            rank, i = divmod(heapq.heappop(heap), n)
            j = after[i]
            # An entry is stale if either symbol has merged with another since it was pushed.
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << shift | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = becomes[rank], -1
            left -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(symbols[i] << shift | symbols[k])) is not None:
                    heapq.heappush(heap, r * n + i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << shift | symbols[i])) is not None:
                heapq.heappush(heap, r * n + h)
        return left

    def of_word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            n = self.merged(word)
            if len(word) <= self.longest:
                if len(self.words) >= self.keep:
                    self.words.clear()
                self.words[word] = n
        return n

    def __missing__(self, chunk: str) -> int:
        n = sum(map(self.of_word, self.pattern.findall(chunk)))
        if len(chunk) <= self.longest:
            if len(self) >= self.keep:
                self.clear()
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if self.special and self.special.search(text):
            return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))
        return self.plain(text)

    def plain(self, text: str) -> int:
        """Chunks of blanks and a word where all white space is ASCII, else words of the pattern."""
        if OTHER_SPACE.search(text):
            return sum(map(self.of_word, self.pattern.findall(text)))
        return sum(map(self.__getitem__, CHUNK.findall(text)))


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes and n_tokens for every row of ``docs``; ``path`` names the vocabulary's file."""

    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS.clear()
            _COUNTERS[path] = MergeCounter(path)
        count = _COUNTERS[path].count
        for batch in slices(batches, "text"):
            column = batch.column(1)
            tokens = [count(t) for t in column.cast(pa.string()).to_pylist()]
            sizes = pc.binary_length(column).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", texts(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def with_limit(counted: DataFrame, limit: int) -> DataFrame:
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
