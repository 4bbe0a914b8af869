import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from riskloom.llm import attribution, bpe, packing, token_files
from riskloom.llm.encoding import LibraryIds

from .conftest import edges, prose


def odd_texts():
    rnd = random.Random(3)
    bits = ["a", "B", "é", " ", "  ", "\n", ".", ",", "'s", "'", "1", "\t", "　", "x", "y z", "#", "\x85", "日",
            "‍", "😀", "\n\n", "<|endoftext|>", "\x1c", "᠎", "﻿", "ǅ", "²", "½"]
    return ["", " ", "  ", "\n", "a ", " a", "0" * 3000, "ab" * 3000, " " * 999, "\n" * 999, "I'LL don't 'tis",
            *("".join(rnd.choice(bits) for _ in range(rnd.randint(1, 25))) for _ in range(1500)),
            *(t for _, t, *_ in edges() if t)]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return tok


def test_library_ids_and_spans(library):
    own, texts = LibraryIds(), odd_texts()
    assert own.fast is not None
    for t, ids in zip(texts, own.ids(texts), strict=True):
        want = library.encode(t, add_special_tokens=False)
        assert ids.tolist() == want.ids, t
        starts, ends = attribution.spans(ids, own.lengths, t)
        assert list(zip(starts.tolist(), ends.tolist(), strict=True)) == want.offsets, t


def test_sentencepiece_model_encodes_as_tiktoken():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, texts = bpe.Codec(), odd_texts()
    for t, ids in zip(texts, codec.encode(texts), strict=True):
        assert ids == want.encode_ordinary(t), t
        assert codec.decode(ids) == t.encode()
    again = codec.model.encode([bpe.as_piece(raw) for raw in codec.vocabulary])
    assert again == [[i] for i in range(len(codec.vocabulary))]


def test_digests(spark, edge_docs, no_docs, table_dir):
    got = bpe.op4_byte_bpe(spark, table_dir(documents=edge_docs)).collect()
    codec = bpe.Codec()
    want = []
    for k, t, *_ in edges():
        ids = next(codec.encode([t or ""]))
        want.append((k, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.digests(no_docs).count() == 0
    assert bpe.encoded(edge_docs).filter("doc_id = 4").first().ids == next(codec.encode(["one two three"]))


def test_elias_fano():
    rnd = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (5, 3), (64, 64), (1000, 1000), (3000, 10**7), (200, 2**40)):
        ends = np.cumsum(rnd.integers(1, max(2, 2 * top // max(n, 1)), n))
        code = token_files.EliasFano.of(ends)
        assert code.all().tolist() == ends.tolist()
        assert [code.select(i) for i in range(n)] == ends.tolist()
        if n >= 1000:
            bits = 8 * (len(code.low) + len(code.high)) + 32 * len(code.samples)
            assert bits / n < 3.6 + max(0, np.log2(ends[-1] / n))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, edge_docs, no_docs, table_dir, library, tmp_path):
    got = token_files.op6_token_files(spark, table_dir(documents=edge_docs)).collect()
    ids = {(k, t): [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t, *_ in edges()}
    want = sorted((k is not None, k or 0, len(ids[k, t]), crc(ids[k, t])) for k, t, *_ in edges())
    have = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got)
    assert have == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys)
    # Small segments, four-byte ids: the same documents, ids whole.
    token_files.write(edge_docs, str(tmp_path / "small"), id_bytes=4, segment_tokens=100)
    again = token_files.read(spark, str(tmp_path / "small"))
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in again.collect()) == sorted(ids[k, t] for k, t, *_ in edges())
    token_files.write(no_docs, str(tmp_path / "none"))
    assert token_files.read(spark, str(tmp_path / "none")).count() == 0


def test_token_files_are_read_without_a_shuffle_of_ids(spark, edge_docs, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write(edge_docs, folder, segment_tokens=100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the estimates were above it
    try:
        plan = token_files.read(spark, folder)._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert moved and not any(re.search(r"\bids#", columns) for columns in moved)


def test_token_files_by_key(spark, edge_docs, tmp_path):
    """Documents are found by their key and by select; ids that two bytes cannot hold are not wrapped."""
    folder = str(tmp_path / "keyed")
    token_files.write(edge_docs, folder, segment_tokens=100)
    every = sorted(token_files.read(spark, folder).collect(), key=str)
    for k in {r.key for r in every if r.key is not None} | {-5}:
        got = sorted(token_files.read(spark, folder, k).collect(), key=str)
        assert got == [r for r in every if r.key == k]
    assert token_files.bytes_for(None) == 2
    assert token_files.packed(np.array([65_535], "<u4"), 2) == b"\xff\xff"
    with pytest.raises(ValueError):
        token_files.packed(np.array([1, 65_536], "<u4"), 2)
    assert token_files.packed(np.array([65_536], "<u4"), 4) == b"\0\0\1\0"


def test_section_counts(spark, edge_docs, no_docs, library):
    for rule in attribution.RULES:
        got = {}
        for r in attribution.section_counts(edge_docs.filter("doc_id is not null").dropDuplicates(["doc_id"]),
                                            rule=rule).collect():
            got.setdefault(r.doc_id, {})[r.section] = (r.start, r.n_chars, r.n_tokens, r.n_crossing)
        for k, t, *_ in edges():
            if k is None:
                continue
            t = t or ""
            lines = t.splitlines(keepends=True) if False else [x + "\n" for x in t.split("\n")[:-1]] + [t.split("\n")[-1]]
            if len(lines) > 1 and not lines[-1]:
                lines.pop()
            starts = np.cumsum([0, *map(len, lines)])
            counts, crossing = [0] * len(lines), [0] * len(lines)
            for s, e in library.encode(t, add_special_tokens=False).offsets:
                inside = [max(0, min(e, starts[i + 1]) - max(s, starts[i])) for i in range(len(lines))]
                hit = [i for i, n in enumerate(inside) if n]
                own = {"first": hit[0], "last": hit[-1], "most": max(hit, key=lambda i: (inside[i], -i))}[rule]
                counts[own] += 1
                crossing[own] += len(hit) > 1
            assert [got[k][i] for i in range(len(lines))] == [
                (starts[i], len(lines[i]), counts[i], crossing[i]) for i in range(len(lines))], (k, rule)
    assert attribution.section_counts(no_docs).count() == 0
    with pytest.raises(ValueError):
        attribution.section_counts(no_docs, rule="none")


def test_packing(spark, edge_docs, no_docs, table_dir, library):
    got = packing.op5_packing(spark, table_dir(documents=edge_docs)).collect()
    ids = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for k, t, *_ in edges()]
    want = []
    for k, x in ids:
        for i, (at, n) in enumerate(packing.cut(len(x))):
            want.append((k, i, at, n, crc(x[at:at + n])))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(by) == -(-sum(n for _, _, _, n, _ in want) // 2048)
    assert packing.packed(no_docs).count() == 0
    with_ids = packing.packed(edge_docs, with_ids=True).filter("doc_id = 4").first()
    assert np.frombuffer(with_ids.ids, "<u4").tolist() == dict(ids)[4]


def test_cut():
    for n in (1, 5, 9, 10, 11, 20, 21, 39):
        parts = packing.cut(n, 10)
        assert parts[0][0] == 0 and sum(x for _, x in parts) == n and all(x == 10 for _, x in parts[1:])
        assert all(a + x == b for (a, x), (b, _) in zip(parts, parts[1:]))


def test_plan_packs_tightly_and_replaces_the_smallest():
    assert packing.plan(np.bincount([6, 3, 2, 2, 2], minlength=11), 10)[0] == (1, [6, 2, 2])
    rnd = np.random.default_rng(2)
    for _ in range(20):
        lengths = rnd.integers(1, 2048, rnd.integers(1, 900))
        counts = np.bincount(lengths, minlength=2049)
        bins = packing.plan(counts, 2048)
        used = np.zeros_like(counts)
        for times, items in bins:
            assert sum(items) <= 2048
            for x in items:
                used[x] += times
        assert (used == counts).all()
        rooms: list[int] = []  # best fit decreasing, document by document
        for x in sorted(lengths.tolist(), reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms[rooms.index(min(fits))] -= x
            else:
                rooms.append(2048 - x)
        assert sum(t for t, _ in bins) <= len(rooms) * 1.01 + 1


def test_plan_work_does_not_grow_with_documents():
    counts = np.zeros(2049, np.int64)
    counts[1:2048] = np.random.default_rng(1).integers(1, 10**12, 2047)
    bins = packing.plan(counts, 2048)
    assert len(bins) < 10_000
    assert sum(t * sum(i) for t, i in bins) == int((counts * np.arange(2049)).sum())


def test_whole_prose_is_one_piece_of_the_corpus(library):
    text = prose(9, 20_000)
    own = LibraryIds()
    assert next(own.ids([text])).tolist() == library.encode(text, add_special_tokens=False).ids
