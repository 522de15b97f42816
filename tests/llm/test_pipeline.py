"""The pipeline's stages follow one another over the whole table, and each decision takes effect."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa

import corpus_pipeline
from panelytics.llm import common, decontaminate, pieces, simhash, toxicity

SF = "/root/testdata/sf0.001"


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    own = (text or "").encode().lower().split()
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} - {()}


def near_copies_of(docs) -> dict[int, int]:
    """By brute force: the documents that are not the least of their component, with a document they are a near copy of."""
    rows = sorted((r["doc_id"], shingles(r["text"])) for r in docs.collect())
    root, of = {d: d for d, _ in rows}, {}

    def find(d: int) -> int:
        while root[d] != d:
            d = root[d]
        return d

    for i, (d, own) in enumerate(rows):
        for e, other in rows[:i]:
            if own == other or 5 * len(own & other) >= 4 * len(own | other):
                of[d] = e
                low, high = sorted((find(d), find(e)))
                root[high] = low
    return {d: of.get(d, root[d]) for d, _ in rows if find(d) != d}


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    toxic = {r["doc_id"] for r in toxicity.score_documents(docs, labels).where("predicted = 1").collect()}
    left = docs.where(~docs.doc_id.isin(list(toxic)))
    copies = near_copies_of(left)
    # Similarity finds what fingerprints of op4 find, and on these documents two near copies more.
    marked = {r["doc_id"] for r in simhash.near_duplicates(left).where("doc_id <> component_id").collect()}
    assert marked < set(copies) and len(set(copies) - marked) == 2
    left = left.where(~left.doc_id.isin(list(copies)))
    leaks = {r["doc_id"] for r in decontaminate.matches(left, bench).collect()}
    want = {r["doc_id"] for r in docs.select("doc_id").collect()} - toxic - set(copies) - leaks
    out = corpus_pipeline.run(spark, SF)
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(got) == sorted(want) and copies and leaks
    at = docs
    for _, step in corpus_pipeline.STAGES[:-1]:
        at = step(spark, at, SF)
        assert at.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_every_operator_is_registered_once():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") and n[2:].split("_")[0].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and {"op6_license_scan", "op11_merkle_manifest", "op13_vector_codes"} <= set(entry.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "sentencepiece"]


def test_an_encoding_stage_keeps_nothing_of_earlier_ones(spark):
    """Workers outlive the stages; what the toxicity and benchmark stages built must not stay beside the chunk table."""
    docs = spark.createDataFrame([(1, "one two")], "doc_id bigint, text string").coalesce(1)

    def leave(batches):
        common._BUILT["toxicity"] = (None, bytes(1000))
        yield from batches

    def left(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(common._BUILT)] * batch.num_rows, pa.int32())], ["n"])

    docs.mapInArrow(leave, docs.schema).collect()
    pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert [r.n for r in docs.mapInArrow(left, "n int").collect()] == [0]
