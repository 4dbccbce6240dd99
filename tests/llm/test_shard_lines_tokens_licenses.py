import hashlib
import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from folioquarry.llm import licenses, linededup, queries, sharding, tokenbin

SCHEMA = "doc_id long, text string, lang string, size int, h long, _keep string, pos int"


def frame(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", 1, 2, "x", 3) for i, t in rows], SCHEMA)


HARD = [
    (1, None), (2, ""), (3, "a\nb\n"), (None, "the very same line here\nnull id"), (4, "The very same line here \nx"),
    (4, "The very same line here \nx"), (5, "word " * 40_000), (6, "word " * 40_000), (7, "the very same line here\r\n\tTHE VERY SAME LINE HERE"),
    (8, "Released under the MIT License.\nGNU General\nPublic, License apache-license mit license"), (9, "éÉ emoji \U0001f600 line of text　\n\n\n"), (10, "ÀB c"), (11, " odd  spaces\t\there \n\n x"),
]


@pytest.fixture(params=["hard", "table", "empty"])
def docs(request, spark, sf):
    if request.param == "table":
        return spark.read.parquet(f"{sf}/documents.parquet")
    return frame(spark, HARD if request.param == "hard" else [])


def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_shards(docs):
    got, rows = sharding.assign_shards(docs).collect(), texts(docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    load = Counter()
    for r in got:
        assert 0 <= r["shard"] < 8 and r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    if rows:
        mean = sum(load.values()) / 8
        assert all(abs(load[s] - mean) <= max(r["size"] for r in got) + 0.02 * mean for s in range(8))


def test_shards_follow_the_order_of_keys(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sharding.assign_shards(docs).collect()
    text = dict(texts(docs))
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    order = sorted(got, key=lambda r: (signed(xxhash.xxh64_intdigest(text[r["doc_id"]].encode(), seed=42)), r["doc_id"]))
    assert [(r["shard"], r["slot"]) for r in order] == sorted((r["shard"], r["slot"]) for r in got)


def test_a_hot_group_is_subdivided(spark):
    docs = frame(spark, [(i, "same text" if i % 3 == 0 else f"text number {i}") for i in range(6000)])
    load = Counter()
    for r in sharding.assign_shards(docs).collect():
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 8


def brute_lines(rows):
    space = "\x20\x09\x0a\x0b\x0c\x0d"
    fold = lambda x: x.strip(space).translate({c: c + 32 for c in range(65, 91)})
    low = lambda i: -(2**63) if i is None else i
    held = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(fold(x)) >= 10:
                held[fold(x)].add(low(i))
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(fold(x)) < 10 or low(i) == min(held[fold(x)])]
        out[(i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
    return out


def test_lines(docs):
    assert Counter(tuple(r) for r in linededup.line_digests(docs).collect()) == brute_lines(texts(docs))


@pytest.mark.parametrize("parts", [3, 40])
def test_a_hot_line_crosses_tasks(spark, parts):
    rows = [(i, f"a line that is everywhere\nown line of document {i}\nsecond line of {i % 7} shared") for i in range(900)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        assert Counter(tuple(r) for r in linededup.line_digests(frame(spark, rows)).collect()) == brute_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_cut_texts(spark):
    rows = {r["doc_id"]: r for r in linededup.dedup_lines(frame(spark, HARD)).collect()}
    assert rows[4]["text"] == "x" and rows[1]["text"] is None and rows[7]["text"] == "" and rows[6]["text"] == ""
    assert linededup.dedup_lines(frame(spark, HARD)).columns == frame(spark, HARD).columns


def test_bitmaps_round_trip():
    keep = linededup.unpack(linededup.pack([0, 3, 17]))
    assert list(np.flatnonzero(~keep)) == [0, 3, 17] and len(keep) == 18


def test_lines_oracle(spark, sf, duck, same):
    same(queries.op10_line_dedup(spark, sf), duck.execute(linededup.ORACLE_SQL))


def brute_base(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for k in range(len(words)) for phrase, label in licenses.BASE.items() if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), len(places), *((places[0][0], places[-1][0]) if places else (None, None)), ",".join(sorted({x for _, x in places}))


def test_licenses(docs):
    got = licenses.license_labels(docs).collect()
    assert Counter((r["doc_id"], *r[1:6]) for r in got) == Counter((i, *brute_base(t)) for i, t in texts(docs))
    for r in got:
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
        ("GNU Lesser General Public License", "lgpl"),
        ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc"),
        ("// SPDX-License-Identifier: BSD-3-Clause", "bsd"),
        ("see https://www.apache.org/licenses/LICENSE-2.0 for details", "apache"),
        ("the mitigation of a licence", ""),
        ("GNU Affero General Public License v3", "agpl"),
    ],
)
def test_license_rules(text, labels):
    _, places, found = licenses.scan(text)
    every = licenses.rules()
    assert ",".join(sorted({x for _, x in places} | {every[k].label for k, _, _ in found})) == labels
    spans = [(a, b) for _, a, b in found]
    assert not any(x != y and x[0] <= y[0] and y[1] <= x[1] for x in spans for y in spans)
    assert len(every) >= 300


def tokenizer():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(queries._tokenizer("byte_bpe_50k.json"))
    return made


def test_token_files(docs):
    got = tokenbin.token_file_digests(docs, queries._tokenizer("byte_bpe_50k.json")).collect()
    made, start, want = tokenizer(), 0, Counter()
    crc = {}
    for i, t in texts(docs):
        ids = [*made.encode(t or "", add_special_tokens=False).ids, 0]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
        crc[i] = len(ids)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)


def test_frames_open_one_by_one_and_show_damage():
    sink = io.BytesIO()
    writer = tokenbin.Writer(sink, frame_bytes=64)
    payloads = [np.arange(k, dtype="<u4") for k in range(40)]
    for k, p in enumerate(payloads):
        writer.add(k * 2, p)
    writer.close()
    raw = sink.getvalue()
    reader = tokenbin.Reader(io.BytesIO(raw))
    assert len(reader.frames) > 10 and all((reader.document(k) == payloads[k]).all() for k in range(40))
    assert reader.find(20) == [10] and reader.find(21) == []
    bad = bytearray(raw)
    bad[int(reader.frame_at[5]) + 12] ^= 1
    damaged = tokenbin.Reader(io.BytesIO(bytes(bad)))
    assert damaged.frame(0) == reader.frame(0)
    with pytest.raises(Exception):
        damaged.frame(5)


def test_the_public_layout_is_readable_by_another_reader():
    """A plain reader of the public seekable layout: the table is the last frame, its entries cover every frame before it."""
    import struct

    import xxhash
    import zstandard

    sink = io.BytesIO()
    writer = tokenbin.Writer(sink, frame_bytes=64)
    for k in range(40):
        writer.add(k, np.arange(k, dtype="<u4"))
    writer.close()
    raw = sink.getvalue()
    count, flags, magic = struct.unpack("<IBI", raw[-9:])
    at = len(raw) - 9 - 12 * count - 8
    assert magic == 0x8F92EAB1 and flags == 0x80 and struct.unpack("<II", raw[at : at + 8]) == (0x184D2A5E, 12 * count + 9)
    place, out = 0, b""
    for k in range(count):
        packed, size, check = struct.unpack_from("<III", raw, at + 8 + 12 * k)
        frame = raw[place : place + packed]
        if size:
            data = zstandard.ZstdDecompressor().decompress(frame, max_output_size=size)
        else:
            assert struct.unpack("<I", frame[:4])[0] & 0xFFFFFFF0 == 0x184D2A50
            data = b""
        assert len(data) == size and xxhash.xxh64_intdigest(data) & 0xFFFFFFFF == check
        out += data
        place += packed
    assert place == at and out == b"".join(np.arange(k, dtype="<u4").tobytes() for k in range(40))
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True) as whole:
        assert whole.read() == out


@pytest.mark.parametrize("most", [1, 7])
def test_files_end_at_their_size(spark, docs, most, monkeypatch, tmp_path):
    want = Counter(map(tuple, tokenbin.token_file_digests(docs, queries._tokenizer("byte_bpe_50k.json")).collect()))
    monkeypatch.setattr(tokenbin, "FILE_DOCS", most)
    path = f"file://{tmp_path}/tokens"
    files = tokenbin.write(docs, queries._tokenizer("byte_bpe_50k.json"), path)
    assert max((f[2] for f in files), default=0) <= most and sum(f[2] for f in files) == docs.count()
    assert Counter(map(tuple, tokenbin.read(spark, files, path).collect())) == want


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "a  b\n\n c", " lead", "trail \n ", "it's we'll  don't\n'quoted'", "x\t\n y　z   w", "1 2  33\n4", "a,  b  ,c\n\n", "Été, naïve's ×÷ don't. can't... (x) [y]-z` ~q 'll", "<|endoftext|> <|endoftext|>x"])
def test_cut_segments_encode_as_the_whole(text):
    encoder = tokenbin._encoder(queries._tokenizer("byte_bpe_50k.json"))
    for texts in ([text], ["", text, "x", text + text, ""], ["a" * 100 + text, "a" * 64, "a" * 65 + " b", "a" * 64 + "c"]):
        assert [p.tolist() for p in encoder.payloads(texts)] == [tokenizer().encode(t, add_special_tokens=False).ids for t in texts]


def strings_of(parsed):
    """Strings that a pattern matches: every branch, optional parts with and without, one of each other set."""
    out = {""}
    for op, arg in parsed:
        op = str(op)
        if op == "LITERAL":
            more = {chr(arg)}
        elif op == "SUBPATTERN":
            more = strings_of(arg[3])
        elif op == "BRANCH":
            more = {x for a in arg[1] for x in strings_of(a)}
        elif op == "ANY":
            more = {"x"}
        elif op in ("MAX_REPEAT", "MIN_REPEAT"):
            more = strings_of(arg[2]) | ({""} if arg[0] == 0 else set())
        elif op == "IN":
            more = {" "} if str(arg[0][0]) == "NEGATE" else {chr(v if str(o) == "LITERAL" else v[0]) for o, v in arg}
        else:
            assert op == "ASSERT_NOT"
            more = {""}
        out = {a + b for a in out for b in more}
    return out


def test_keywords_occur_in_all_that_a_rule_matches():
    from re import _parser

    for r in licenses.rules():
        if r.pattern.pattern.startswith(b"(?<!") and r.priority not in (40, 85):
            continue  # templates around the bare name
        for t in strings_of(_parser.parse(r.pattern.pattern)):
            assert any(k in t for k in r.keywords), (r.label, t)


@pytest.mark.parametrize("text, label", [("GNU Library General Public License", "lgpl"), ("under the Expat License", "mit")])
def test_names_without_the_first_keyword(text, label):
    assert label in {licenses.rules()[k].label for k, _, _ in licenses.scan(text)[2]}


def plain_detections(text):
    """Every rule over the whole text, without keywords; a detection inside an earlier one goes, each pair compared."""
    folded = (text or "").encode().lower()
    every = licenses.rules()
    hits = sorted(((-r.priority, m.start() - m.end(), m.start(), k, m.end()) for k, r in enumerate(every) for m in r.pattern.finditer(folded)))
    stay = []
    for _, _, start, k, stop in hits:
        if not any(a <= start and stop <= b for _, a, b in stay):
            stay.append((k, start, stop))
    return stay


def test_labels_and_score_agree_with_brute_force(spark):
    rng = random.Random(21)
    phrases = ["GNU General Public License", "Apache License, Version 2.0", "CC BY 4.0", "MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Redistribution and use in source and binary forms, with or without modification, are permitted", "released into the public domain", "SPDX-License-Identifier: BSD-3-Clause", "https://www.gnu.org/licenses/gpl-3.0.html", "Copyright 2020 Some One.\nAll rights reserved", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "licensed under the Mozilla Public License v2.0", "This program is distributed under the terms of the GNU Lesser General Public License version 2.1 or later", "public domain debate", "the software shall be used for Good, not Evil"]
    rows = [(None, None), (1, ""), (2, "mit license " * 3000)]
    for k in range(120):
        words = [rng.choice(["the", "license", "free", "public", "under", "x", "é"]) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(4)):
            words.insert(rng.randint(0, len(words)), rng.choice(phrases))
        rows.append((k + 3, " ".join(words)))
    got = {r["doc_id"]: r for r in licenses.license_labels(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    spans = Counter((r["doc_id"], r["label"], r["start"], r["stop"]) for r in licenses.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    every, want = licenses.rules(), Counter()
    for i, text in rows:
        found = plain_detections(text) if i != 2 else None
        if found is None:
            assert got[i]["n_base"] == 3000 and got[i]["labels"] == "mit"
            want.update({k: n for k, n in spans.items() if k[0] == 2})
            continue
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == base | {every[k].label for k, _, _ in found}
        miss = 0.1 ** len(base)
        for k, _, _ in found:
            miss *= 1 - every[k].confidence
        assert abs(got[i]["score"] - (1 - miss)) < 1e-12
        want.update((i, every[k].label, a, z) for k, a, z in found)
    assert spans == want


@pytest.mark.parametrize("text, label", [("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"), ("Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided", "bsd"), ("You can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl"), ("CreativeML OpenRAIL-M license", "openrail"), ("creative commons attribution-noncommercial-sharealike", "cc-by-nc-sa")])
def test_sentences_of_license_texts(text, label):
    assert label in {licenses.rules()[k].label for k, _, _ in licenses.scan(text)[2]}


def test_a_bare_word_is_no_license():
    assert licenses.scan("a public domain debate")[2] == []


def test_written_shards_hold_all_rows_and_columns(spark, tmp_path):
    rows = [(i, f"text {i % 7} " * (i % 5 + 1), "x", i * 2) for i in range(60)] + [(3, "text 3 " * 4, "y", 6), (None, None, None, None), (None, "", "z", 1), (3, "text 3 " * 4, "y", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, slot int")
    sharding.write_shards(docs, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r["doc_id"], r["text"], r["lang"]) for r in got) == Counter((i, t, x) for i, t, x, _ in rows)
    placed = sharding.assign_shards(docs, 4).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((r["shard"], r["slot"]) for r in placed)
    for s in range(4):
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"), 4)
