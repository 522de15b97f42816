"""Byte-pair encoding and decoding with forced boundaries.

Every merge joins two neighbouring symbols. A pair of symbols that no merge has at its joint occurs inside no token, so no
token can ever reach across it: it is a certain cut. Words are split at these cuts, each fragment is encoded by itself
(merges of lowest rank first, then leftmost, by a heap over a linked list), and the ids are put together again. Fragments
and words that a worker has met are kept in tables of bounded size, long ones are not kept.

The file's normaliser (NFC, blanks, lower case) and its word pattern are applied here to texts of characters on which both
libraries' Unicode tables agree; a text with any other character goes through the file's own normaliser and splitter, so
that the result is the same for every text. Strings of special tokens inside a text become these tokens, as is the
library's default. Without a decoder, ids are decoded to their tokens with a blank between them.

Defined results: null text is empty and has no ids. Rows are encoded one by one, repeated rows alike, and other columns do
not matter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.llm.common import slices, texts

END = "</w>"
#: Characters on which both libraries agree, none of which combines with another: Latin, Cyrillic, general punctuation,
#: kana, Han, Hangul. Tests compare every one of them.
AGREED = "\\u0000-\\u02ff\\u0400-\\u0482\\u048a-\\u052f\\u2010-\\u2027\\u20ac\\u3001-\\u3029\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fff\\uac00-\\ud7a3"
OTHER = re.compile(f"[^{AGREED}]")
_MODELS: dict[str, "WordBpe"] = {}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next free one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    letter = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letter[b] for b in range(256)]


class WordBpe:
    """A byte-level model with word ends, read from its file."""

    def __init__(self, path: str, keep: int = 300_000, longest: int = 64) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.keep, self.longest = spec["model"], keep, longest
        plain = model.get("end_of_word_suffix") == END and not any(
            model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        )
        normal = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        split, *letters = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        bytewise = [(p["type"], p["add_prefix_space"], p["use_regex"]) for p in letters] == [("ByteLevel", False, False)]
        worded = split.get("type") == "Split" and split["invert"] and split["behavior"] == "Removed"
        added = spec["added_tokens"]
        if not plain or normal != ["NFC", "Replace", "Lowercase"] or not bytewise or not worded or spec["decoder"] or spec["post_processor"]:
            raise ValueError("not a byte-level model of lower-case words with word ends")
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in what surrounds them")

        self.words = regex.compile(split["pattern"]["Regex"])
        self.library = tokenizers.Tokenizer.from_file(path)
        self.splitter = tokenizers.pre_tokenizers.Split(tokenizers.Regex(split["pattern"]["Regex"]), "removed", invert=True)
        vocabulary = model["vocab"]
        self.surface = {i: t for t, i in vocabulary.items()} | {t["id"]: t["content"] for t in added}
        self.special = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        letter = byte_letters()
        # A symbol is a byte, or 256 more for a byte that ends a word.
        self.symbol_id = [vocabulary[c] for c in letter] + [vocabulary[c + END] for c in letter]
        self.joined, self.inside = {}, bytearray(512 * 512)
        edges = {t: (s, s) for s, t in enumerate([*letter, *(c + END for c in letter)])}
        for rank, (left, right) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            whole = left + right
            self.joined[vocabulary[left], vocabulary[right]] = (rank, vocabulary[whole])
            edges.setdefault(whole, (edges[left][0], edges[right][1]))
            self.inside[edges[left][1] * 512 + edges[right][0]] = 1
        self.known: dict[str, tuple[bytes, str]] = {}
        self.pieces: dict[tuple[int, ...], list[int]] = {}

    def fragments(self, word: bytes) -> list[tuple[int, ...]]:
        """Symbols of a word, cut wherever two neighbours occur inside no token."""
        symbols = [*word[:-1], word[-1] + 256]
        cuts = [i for i in range(1, len(symbols)) if not self.inside[symbols[i - 1] * 512 + symbols[i]]]
        return [tuple(symbols[a:b]) for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True)]

    def merge(self, ids: list[int]) -> list[int]:
        """Joins the neighbours of lowest rank, the leftmost first, until none can be joined."""
        joined, n = self.joined, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(joined[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in joined]
        heapify(heap)
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            if ids[i] != pair[0] or j >= n or ids[j] != pair[1]:
                continue  # one of the two has been joined to another since
            ids[i], ids[j] = joined[pair][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := (ids[i], ids[k])) in joined:
                    heappush(heap, (joined[p][0], i, p))
            if (h := before[i]) >= 0 and (p := (ids[h], ids[i])) in joined:
                heappush(heap, (joined[p][0], h, p))
        return [i for i in ids if i >= 0]

    def encode_word(self, word: str) -> list[int]:
        ids: list[int] = []
        for fragment in self.fragments(word.encode()):
            if (own := self.pieces.get(fragment)) is None:
                own = self.merge([self.symbol_id[s] for s in fragment])
                if len(fragment) <= self.longest:
                    if len(self.pieces) >= self.keep:
                        self.pieces.clear()
                    self.pieces[fragment] = own
            ids += own
        return ids

    def row(self, ids: list[int]) -> tuple[bytes, str]:
        """Ids as 32-bit numbers, and their tokens."""
        return np.array(ids, dtype=np.int32).tobytes(), " ".join([self.surface[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Words of the normalised text."""
        if text.isascii():
            return self.words.findall(text.lower())
        if OTHER.search(text) is None:
            return self.words.findall(unicodedata.normalize("NFC", text).lower())
        return [w for w, _ in self.splitter.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as 32-bit numbers one after another, and the decoded text."""
        rows: list[tuple[bytes, str]] = []
        for i, segment in enumerate(self.specials.split(text) if self.specials else [text]):
            if i % 2:
                rows.append(self.row([self.special[segment]]))
                continue
            words = self.split(segment)
            known = self.known
            try:
                rows += [known[w] for w in words]
                continue
            except KeyError:
                missing = {w for w in words if w not in known}
            if len(known) + len(missing) > self.keep:
                known.clear()
                missing = set(words)
            new = {w: self.row(self.encode_word(w)) for w in missing}
            known.update(new)
            rows += [known[w] for w in words]
            for w in new:
                if len(w) > self.longest or len(new) > self.keep:
                    del known[w]
        return b"".join([r[0] for r in rows]), " ".join([r[1] for r in rows])


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded text for every row of ``docs``; ``path`` names the model's file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _MODELS:
            _MODELS.clear()
            _MODELS[path] = WordBpe(path)
        model = _MODELS[path]
        for batch in slices(batches, "text", 8 << 20):
            rows = [model.encode(t) for t in batch.column(1).cast(pa.string()).to_pylist()]
            offsets = np.cumsum([0, *(len(r[0]) // 4 for r in rows)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join([r[0] for r in rows]), dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([r[1] for r in rows], pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", texts(docs).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of what ``encode_decode`` returns."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
