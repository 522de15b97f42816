"""Encoding and decoding against the library, and the alphabet on which the two libraries agree."""

from __future__ import annotations

import hashlib
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from panelytics.llm import word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = tokenizers.Tokenizer.from_file(PATH)
MODEL = word_bpe.WordBpe(PATH)

TEXTS = [
    "",
    " ",
    "It's the CAT's 123rd  naïve café … they'll\tWE'VE\n",
    "a<|endoftext|>b <|startoftext|><|endoftext|>",
    "<|ENDOFTEXT|> <|endoftext|",
    "</w> word</w> a</wb",
    "İstanbul ΑΣ Σ ὈΔΥΣΣΕΎΣ ﬁ ǅ",
    "é Å ͅ 가 क् 👩‍👩‍👧 🇩🇪",
    "\x00\x1c\x1d\x1e\x1f\x85 ​﻿",
    "漢字かなカナ 한국어 Привет МИР",
    "¹²³½ ٣ ⅷ",
    "՘֋ᲉꟋ\U00010d50",
]


def library(text: str) -> tuple[list[int], str]:
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def own(text: str, model=MODEL) -> tuple[list[int], str]:
    ids, decoded = model.encode(text)
    return np.frombuffer(ids, dtype=np.int32).tolist(), decoded


@pytest.mark.parametrize("text", TEXTS)
def test_texts(text):
    assert own(text) == library(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="ab'sétTHE 1.,<|>/w\n", max_size=60))
def test_any_text(text):
    assert own(text) == library(text)


def test_every_agreed_character():
    """Alone and between letters; no character of the alphabet has a reading of its own in one library only."""
    agreed = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if not word_bpe.OTHER.search(c)]
    assert len(agreed) > 30_000 and not any(unicodedata.combining(c) for c in agreed)
    for c in agreed:
        text = f"a{c}b {c}"
        split = MODEL.splitter.pre_tokenize_str(LIBRARY.normalizer.normalize_str(text))
        assert MODEL.split(text) == [w for w, _ in split], hex(ord(c))


def test_cuts_are_certain_and_taken():
    """No token reaches across a cut; fragments encoded alone give the ids of the whole word."""
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzéüß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 30))) for _ in range(400)]
    cut = 0
    for word in words:
        parts = MODEL.fragments(word.encode())
        cut += len(parts) > 1
        whole = MODEL.merge([MODEL.symbol_id[s] for p in parts for s in p])
        assert whole == [i for p in parts for i in MODEL.merge([MODEL.symbol_id[s] for s in p])]
    assert cut > 40


def test_long_words_and_small_tables():
    small = word_bpe.WordBpe(PATH, keep=3, longest=4)
    for text in ("a" * 300_000, "ab" * 20_000 + " x", "one two three four five one", "Ä" * 5_000):
        assert own(text, small) == library(text)
        assert len(small.known) <= 3 and len(small.pieces) <= 3


def test_documents(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate([*TEXTS, None, TEXTS[2], TEXTS[2]])] + [(None, "null id", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in word_bpe.digests(word_bpe.encode_decode(docs, PATH)).collect()}
    want = set()
    for doc_id, text, *_ in rows:
        ids, decoded = library(text or "")
        shown = (" ".join(map(str, ids)), decoded)
        want.add((doc_id, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in shown)))
    assert got == want
    assert word_bpe.encode_decode(docs.limit(0), PATH).collect() == []


def test_unsuited_files_are_refused():
    with pytest.raises(ValueError):
        word_bpe.WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
