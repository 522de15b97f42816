"""Text operators against brute-force versions and the libraries whose results they must equal."""

from __future__ import annotations

import hashlib
import math
import random
import textwrap
import zlib
from collections import Counter

import duckdb
import pytest
import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from panelytics.llm import decontaminate, licenses, pieces, sharding, simhash, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b   ", "\t", "\n\n a\n", "\x00", "a\x00b", "\x1c \x1c", "x\x1d y", " ", "   ", "a  b", "  x　y",
    "▁", "▁▁a", "a ▁ b", "<s></s><unk>", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext|", "don't we'LL it'S 'tis 's", "...  !!", "١٢٣ ⅷ ²",
    "é è ü ß ñ 漢字かな", "😀👩‍👩‍👧 \U0001f1e9\U0001f1ea", "́a", "x" * 3_000, "ab " * 5_000, " " * 300, "<0x0A>", "﻿bom", "�", "\r\n\r\n", "1234567", "A B ",
]


def random_texts(n: int, seed: int = 1) -> list[str]:
    rng = random.Random(seed)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "漢", "'s", "'", "1", "22", ".", "!?", " ", "😀", "<|endoftext|>", "<s>", "▁", "Ab", "tion", "\x1e", "̀", "\r"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd and random texts, repeated rows, null ids and columns with clashing names."""
    texts = ODD + random_texts(300)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, ODD[3], "x", 1), (None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, fp int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def plain(df):
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


def test_pieces_equal_the_library(odd, nothing):
    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = sorted(map(tuple, pieces.digests(pieces.encode_decode(odd, PIECES)).collect()), key=str)
    want = []
    for i, t in plain(odd):
        ids = p.encode(t) + [p.eos_id()]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(p.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert pieces.encode_decode(nothing, PIECES).count() == 0


def test_pieces_with_a_small_table():
    p = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    table = pieces.ChunkTable(PIECES, keep=3, longest=2)
    for t in [x or "" for x in ODD] + random_texts(50, 2):
        ids = p.encode(t)
        assert table.encode(t) == (ids, p.decode(ids)), repr(t)
        assert len(table.known) <= 3 or len(table.known) <= len(set(table.chunks(t)))


def test_token_counts_equal_the_library(odd, nothing):
    t = Tokenizer.from_file(BYTES)
    got = sorted(map(tuple, token_counts.with_limit(token_counts.count_tokens(odd, BYTES), 1024).collect()), key=str)
    want = [(i, len(x.encode()), n := len(t.encode(x, add_special_tokens=False).ids), n > 1024) for i, x in plain(odd)]
    assert got == sorted(want, key=str)
    assert token_counts.count_tokens(nothing, BYTES).count() == 0


def slow_fingerprint(text: str) -> int:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    w = [x for x in lower.translate({i: " " for i in range(9, 14)}).split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(values: list[int], radius: int) -> list[int]:
    label = list(range(len(values)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_simhash_equals_brute_force(spark, odd, nothing):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["on", "The", "ea", "re", "st", "wh", "is", "Ü"]) for _ in range(60)) for _ in range(25)]
    near = [b.replace("on", "no", rng.randint(0, 2)) for b in base for _ in range(4)]
    rows = plain(odd)[:-2] + [(1_000 + i, t) for i, t in enumerate(base + near + base[:5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    values = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(values, 2)
    want = sorted((i, f"{v:016x}", min(rows[k][0] for k in range(len(rows)) if roots[k] == r)) for (i, _), v, r in zip(rows, values, roots, strict=True))
    found = simhash.near_duplicates(docs)
    assert sorted(map(tuple, found.select("doc_id", simhash.hexadecimal(), "component_id").collect())) == want
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.keep_one(docs.selectExpr("doc_id", "text", "1 AS fp", "2 AS row"))
    assert kept.columns == ["doc_id", "text", "fp", "row"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({w[2] for w in want})
    repeated = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "d e f"), (None, "d e f")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in simhash.keep_one(repeated).collect()))) == ["5", "None"]
    assert {tuple(r)[0::2] for r in simhash.near_duplicates(repeated).collect()} == {(None, 5), (5, 5), (None, None)}


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_edges_of_hot_keys_in_tiles(spark, radius):
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for c in centres for _ in range(60)}
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = [(a, b) for a, b in simhash.near_edges(nodes, radius, tile=16).collect()]
    mask = (1 << 64) - 1
    roots = slow_components([v & mask for v in values], radius)
    want = {v: values[r] for v, r in zip(values, roots, strict=True)}
    linked = dict(map(tuple, simhash.components(spark.createDataFrame(edges or [(1, 1)], "a long, b long")).collect()))
    classes = {}
    for v in values:
        classes.setdefault(want[v], set()).add(linked.get(v, v))
    assert all(len(c) == 1 for c in classes.values()) and len({next(iter(c)) for c in classes.values()}) == len(classes)


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(i + 1_000, 1_000) for i in range(1, 50)]
    random.Random(0).shuffle(chain)
    got = dict(map(tuple, simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(201)} | {i: 1_000 for i in range(1_000, 1_050)}


def slow_distance(passage: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def least_distance(item: str, text: str, s: decontaminate.Settings) -> int | None:
    """Of what counts as found: every part of a long item is compared with the whole text."""
    n = len(item)
    if not n:
        return None
    if n < s.least:
        return 0 if f" {item} " in f" {text} " else None
    myers = decontaminate.Matcher(([], s)).distance
    parts = [item[a : a + s.passage] for a in range(max(1, n - s.passage + 1))]
    best = min(myers(len(p), decontaminate.bits_of(p), text)[0] for p in parts)
    return best if best <= min(n, s.passage) // s.rate else None


def test_myers_distance_equals_the_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 40))) for _ in range(2))
        assert decontaminate.Matcher(([], decontaminate.Settings())).distance(len(a), decontaminate.bits_of(a), b)[0] == slow_distance(a, b)


def test_short_items_and_parts_at_any_offset(spark):
    """An exact copy of a short item, and parts of 140 characters with up to ten edits, wherever they begin."""
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n))
    item = prose(120)
    docs = [(0, "Well: what is the CAPITAL of France?"), (1, "what is the capital of francesca"), (2, prose(60))]
    for at in range(0, len(item) - 140, 13):
        letters = list(item[at : at + 140])
        for _ in range(rng.randint(0, 10)):
            letters[rng.randrange(len(letters))] = rng.choice(["", "q"])
        docs.append((100 + at, f"{prose(15)} {''.join(letters)} {prose(15)}"))
    bench = spark.createDataFrame([(0, "What is the capital of France?"), (1, item)], "item_id long, text string")
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.matches(frame, bench).collect()}
    assert set(got) == {(0, 0)} | {(i, 1) for i, _ in docs if i >= 100}
    assert docs[0][1][got[0, 0]["start"] : got[0, 0]["end"]] == "what is the CAPITAL of France"
    for i, t in docs[3:]:
        assert got[i, 1]["distance"] == least_distance(decontaminate.normalised(item), decontaminate.normalised(t), decontaminate.Settings())


def test_decontamination_equals_brute_force(spark, nothing):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.choice([12, 30, 60]))) for i in range(6)] + [(6, "Much too short."), (7, None), (8, ""), (None, prose(30))]
    docs = []
    for n in range(60):
        item = rng.choice(items[:6] + items[-1:])[1]
        letters = list(item)
        for _ in range(rng.randint(0, 14)):
            at = rng.randrange(len(letters))
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "e", "Ö", ", "])
        cut = "".join(letters)[: rng.choice([len(item), len(item) * 2 // 3, 30])]
        docs.append((n, f"{prose(20)}. {cut.upper() if n % 3 else cut}! {prose(20)}" if n % 4 else prose(80)))
    docs += [(64, "this is much, too short!"), (65, "as much too shortly"), (60, None), (61, ""), (62, items[0][1] + " " + items[1][1]), (62, items[0][1] + " " + items[1][1]), (None, items[2][1]), (63, "  İ.. " + items[0][1] + "..")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item_id string, distance int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    s = decontaminate.Settings(passage=64)
    want = []
    for i, t in docs:
        for k, item in items:
            least = least_distance(decontaminate.normalised(item or ""), decontaminate.normalised(t or ""), s)
            if least is not None:
                want.append((i, k, least))
    got = decontaminate.matches(frame, bench, s)
    assert sorted([(r["doc_id"], r["item_id"], r["distance"]) for r in got.collect()], key=str) == sorted(want, key=str)
    small = decontaminate.Settings(passage=64, block=200)  # several blocks
    assert len(decontaminate.item_blocks(bench, small)) > 1
    assert sorted(map(str, decontaminate.matches(frame, bench, small).collect())) == sorted(map(str, got.collect()))
    bad = {i for i, _, _ in want}
    for settings in (s, small):
        kept = decontaminate.drop_contaminated(frame, bench, settings)
        assert kept.columns == frame.columns
        assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    for r in got.where("distance = 0 AND doc_id IN (62, 63)").collect():
        t = next(t for i, t in docs if i == r["doc_id"])
        assert decontaminate.normalised(t[r["start"] : r["end"]]).strip() in decontaminate.normalised(dict(items)[r["item_id"]])
    assert decontaminate.matches(nothing, bench, s).count() == 0
    assert decontaminate.drop_contaminated(frame, bench.limit(0), s).count() == len(docs)


def test_positions_follow_the_normalised_text():
    for t in [x for x in ODD if x] + random_texts(200, 5) + ["İstanbul ΑΣ. x", "..a..b.."]:
        at = decontaminate.positions(t)
        form = decontaminate.normalised(t)
        assert len(at) == len(form) and at == sorted(at)
        assert all(c == " " or t[i].lower().startswith(c) or c in t[i].lower() or c == "ς" for c, i in zip(form, at, strict=True))


def test_license_forms(spark, nothing):
    mit = licenses.KNOWN["MIT"]
    same = [mit, "# " + mit.replace("\n", "\r\n# "), mit.upper(), mit.replace("sublicense", "sub-licence"), "Copyright (c) 2020 A. Person\n" + mit, mit.replace('"', "“"), "/* Copyright 1999 B */\n" + mit]
    other = [mit + " More.", "", None, "...", mit[:-30], "the MIT License"]
    rows = [(i, t, "x") for i, t in enumerate(same + other)] + [(0, same[0], "x"), (None, mit, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, license string")
    got = licenses.scan(docs, licenses.known_licenses(spark)).collect()
    assert len(got) == len(rows)
    assert all((r["license"] == "MIT") == (r["doc_id"] is None or r["doc_id"] < len(same)) for r in got)
    assert licenses.scan(nothing, licenses.known_licenses(spark)).count() == 0
    assert licenses.scan(docs, licenses.known_licenses(spark).limit(0)).where("license IS NOT NULL").count() == 0
    forms = licenses.known_licenses(spark).select("name", licenses.digest(licenses.canonical("text")).alias("d")).distinct()
    assert forms.count() == forms.select("d").distinct().count() == len(licenses.forms())


def licence_files() -> list[tuple[str, str]]:
    """Files as they are found: headings of other kinds or none, undated holders, rights reserved on a line of their own."""
    body = {n: t.split("\n\n", 1)[1] for n, t in licenses.KNOWN.items() if n in licenses.HEADINGS}
    mit, bsd, isc = body["MIT"], body["BSD-3-Clause"], body["ISC"]
    return [
        ("BSD-3-Clause", "Copyright (c) 2015, Foo\nAll rights reserved.\n\n" + bsd),
        ("MIT", mit),
        ("MIT", "MIT License\n\nCopyright Jane Doe and contributors\n\n" + mit),
        ("BSD-3-Clause", "Copyright 2020 Foo\n\n" + bsd),
        ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2014 Foo\n\n" + mit),
        ("BSD-3-Clause", "// Copyright 2020 The Foo Authors. All rights reserved.\n//\n" + "\n".join("// " + x for x in textwrap.wrap(bsd, 70))),
        ("ISC", "ISC License\n\nCopyright Foo <a@b.c>\n\n" + isc.replace(" copyright notice and this", "\ncopyright notice and this")),
        ("0BSD", "Copyright Foo\n" + body["0BSD"]),
    ]


def test_licence_files_in_spark_and_in_the_twin(spark):
    """One rule: the twin makes the same forms, also of wrapped texts and of notices that are none."""
    files = licence_files()
    odd = [("", "(c) You must retain\ncopyright holders be"), ("", "a\n\ncopyright x\nb"), ("", "© 2020\n all rights reserved .\nall rights reserved to me"), ("", None), ("", "")]
    odd += [(n, "\n".join(textwrap.wrap(t, w))) for n, t in licenses.KNOWN.items() for w in (40, 63, 90)]
    rows = [(i, t) for i, (_, t) in enumerate(files + odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["license"], r["digest"]) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert [got[i][0] for i in range(len(files))] == [n for n, _ in files]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {i: (lic, d) for i, d, lic in con.execute(licenses.scan_sql()).fetchall()} == got


def test_wrapped_licenses(spark):
    rows = []
    for name, text in licenses.KNOWN.items():
        for width in range(30, 101, 3):
            lines = [line for part in text.split("\n") for line in textwrap.wrap(part, width, break_long_words=False, break_on_hyphens=False) or [""]]
            for head in ("", "# ", " * ", "// "):
                notice = [["Copyright (c) 2020 A. Person"], ["Copyright 1999-2001 B"], ["Copyright [yyyy] [name of copyright owner]"], ["© C"], ["(c) 2011 D"]][width % 5]
                rows.append((name, "\n".join(head + line for line in notice + lines)))
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = licenses.scan(docs, licenses.known_licenses(spark)).where("license IS NULL OR license <> doc_id")
    assert got.count() == 0
    kept = spark.createDataFrame([("(c) You must retain\ncopyright holders be",)], "t string").select(licenses.canonical("t")).first()[0]
    assert kept == "c you must retain copyright holders be"


def test_slots_do_not_depend_on_files(spark):
    """Distinct keys have the same slots in every layout; a key that repeats fills parts of its cell without gaps."""
    docs = spark.range(3_000).selectExpr("id AS doc_id", "concat('t', id % 7) AS text")
    settings = sharding.Settings(weights=(1.0, 1.0, 2.0), cell_rows=50)
    layouts = [sorted(map(tuple, sharding.assign(docs.repartition(n, "text"), settings).collect())) for n in (1, 5)]
    assert layouts[0] == layouts[1]
    hot = docs.unionByName(spark.range(2_000).selectExpr("CAST(5 AS BIGINT) AS doc_id", "'same' AS text"))
    got = sharding.assign(hot, settings).collect()
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_law(spark, odd, nothing):
    settings = sharding.Settings(weights=(1.0, 2.0, 1.0), cell_rows=7)
    rows = plain(odd)
    hot = spark.createDataFrame([(7, "same")] * 200, "doc_id long, text string")
    got = sharding.assign(odd.select("doc_id", "text").unionByName(hot), settings).collect()
    rows += [(7, "same")] * 200

    def score(key, shard, weight):
        u = (int(hashlib.md5(f"{shard}:{'' if key is None else key}".encode()).hexdigest()[:13], 16) + 1) / 2**52
        return -math.log(u) / weight, shard

    def own(key, weights):
        return min(score(key, i, w) for i, w in enumerate(weights))[1]

    want = Counter((i, len(t.encode()) + 8, zlib.crc32(t.encode()), "key", own(i, (1, 2, 1)), own(i, (1, 2, 1, 1))) for i, t in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["grown_shard"]) for r in got) == want
    assert all(r["grown_shard"] in (r["shard"], 3) for r in got)
    for s in range(3):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    many = Counter(r["shard"] for r in sharding.assign(spark.range(4_000).selectExpr("id AS doc_id", "'t' AS text"), settings).collect())
    assert abs(many[1] / 4_000 - 0.5) < 0.04
    assert sharding.assign(nothing).count() == 0
    with pytest.raises(ValueError):
        sharding.assign(nothing, sharding.Settings(weights=(1.0, 0.0)))
