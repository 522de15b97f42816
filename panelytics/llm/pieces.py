"""Encodes and decodes whole texts with a SentencePiece model through a table of distinct chunks.

If no piece of a model holds a white-space marker after another character, a piece cannot cross from one marked word
into the next, and a text's ids are the ids of its marked words one after another. Each worker keeps a table of the
chunks it has met (a run of markers and the characters after it); a chunk is segmented once, decoded once, and the
ids of a text are put together from the table by position. The table is emptied when it holds ``keep`` chunks, and
chunks over ``longest`` characters stay out of it, so memory is bounded for any text.

One table for all workers would need a shuffle of a row for each word of each document, several times the size of the
documents; segmenting a chunk again in another worker is cheaper.

Defined results: null text is empty: only the end id, decoded to the empty text. Rows are encoded one by one, repeated
rows alike, and other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelytics.llm.common import drop_built, slices, texts

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")
_TABLES: dict[str, "ChunkTable"] = {}


class ChunkTable:
    """Ids and decoded surface of every chunk met so far."""

    def __init__(self, path: str, keep: int = 250_000, longest: int = 200) -> None:
        self.processor = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.keep, self.longest = keep, longest
        self.known: dict[str, tuple[list[int], str]] = {}
        self.mark = p.piece_to_id(MARK)
        crossing = re.compile(f"[^{MARK}]{MARK}")
        if any(crossing.search(p.id_to_piece(i)) for i in range(p.get_piece_size())):
            raise ValueError("pieces of this model cross white-space markers")
        if p.encode("a  b ", out_type=str) != p.encode(f"a{MARK}{MARK}b{MARK}", out_type=str) or p.encode("a") == p.encode(" a"):
            raise ValueError("this model changes white space before it segments")

    def segment(self, chunks: list[str]) -> list[tuple[list[int], str]]:
        """Ids and surfaces; the library puts the first marker before a text and drops it from what it decodes."""
        ids = self.processor.encode([c[1:] for c in chunks], num_threads=1)
        ids = [i if len(c) > 1 else [self.mark] for i, c in zip(ids, chunks, strict=True)]
        surfaces = self.processor.decode(ids, num_threads=1)
        return [(i, " " + s) for i, s in zip(ids, surfaces, strict=True)]

    def chunks(self, text: str) -> list[str]:
        """Every chunk begins with a marker, as the library puts one before the text."""
        text = MARK + text.replace(" ", MARK)
        if MARK * 2 not in text and text[-1] != MARK:
            return [MARK + w for w in text[1:].split(MARK)]
        return CHUNK.findall(text)

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids without the end, and the decoded text."""
        if not text:
            return [], ""
        chunks, known = self.chunks(text), self.known
        missing = [c for c in dict.fromkeys(chunks) if c not in known]
        if missing:
            if len(known) + len(missing) > self.keep:
                known.clear()
                missing = list(dict.fromkeys(chunks))
            known.update(zip(missing, self.segment(missing), strict=True))
        rows = [known[c] for c in chunks]
        for c in missing:
            if len(c) > self.longest:
                del known[c]
        return list(chain.from_iterable(r[0] for r in rows)), "".join([r[1] for r in rows])[1:]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (with the end id) and decoded text for every row of ``docs``; ``path`` names the model's file."""

    def run(batches):
        drop_built()
        if path not in _TABLES:
            _TABLES.clear()
            _TABLES[path] = ChunkTable(path)
        chunk_table = _TABLES[path]
        end = [chunk_table.processor.eos_id()]
        for batch in slices(batches, "text"):
            ids, decoded = [], []
            for text in batch.column(1).cast(pa.string()).to_pylist():
                own, back = chunk_table.encode(text)
                ids.append(np.array(own + end, dtype=np.int32))
                decoded.append(back)
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), column, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

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
