from __future__ import annotations

import functools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourgrid.llm import packing, records, registered
from hourgrid.llm.tokens import WordEncoder, public_path

DOCS = "/root/testdata/sf0.001"
ODD = ["", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "a\tb", "it's  don't\n we'll", "<|endoftext|>", "x<", "<| a", "naïve 日本語 é́ \u00a0 b", "A\u2003B\r\nc", "1 22 333\n4", "\x1f", "ß ΑΣ ΟΔΟΣ ", "e\u0301 \u0301x", "a" * 3000, "word. " * 999, "İstanbul ŸŉÅ Ж́ж ОДИН 한글 각 かな か\u3099 中文 é ẞ ﬁ", "İ i̇ Ⱥ ⱥ x\u0301y\u0301 Ω\u2126"]


@functools.cache
def tokenizer(name):
    t = Tokenizer.from_file(public_path(name))
    t.encode_special_tokens = True
    return t


def whole(name, text):
    return tokenizer(name).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("kept", [0, 5, 10000])
def test_words_encoded_apart_give_the_ids_of_the_whole(name, kept):
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice(["ab", " ", "\n", ".", "é", "'s", "\t", "7", "<", "|"]) for _ in range(rng.randrange(40))) for _ in range(300)]
    enc = WordEncoder(public_path(name), kept)
    for _ in range(2):
        found = [x.tolist() for x in enc.ids(pa.array(texts))]
        assert found == [whole(name, t) for t in texts]
    assert [x.tolist() for x in enc.ids(pa.array(["q", None], pa.string()))] == [whole(name, "q"), []]
    assert list(enc.ids(pa.array([], pa.string()))) == []


def frame_of(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(-1) for c in ("key", "ids", "start", "length", "file", "frame")}) if extra else df


def test_records_round_trip_with_ties_nulls_and_clashing_names(spark, tmp_path):
    rows = [(5, "b c"), (None, "n"), (5, "b c"), (-3, None), (2, ""), (9, "long " * 20000), (5, "other")]
    folder, index = str(tmp_path / "r"), str(tmp_path / "i")
    records.write_records(frame_of(spark, rows, extra=True), folder, "byte_bpe_50k.json", 2, file_bytes=20)
    found = records.with_start(records.write_index(spark, folder, index)).orderBy("start").collect()
    assert [r.doc_id for r in found] == [None, -3, 2, 5, 5, 5, 9]
    assert [r.start for r in found] == np.cumsum([0] + [r.n_tokens for r in found])[:-1].tolist()
    ids = {r.place: r.ids for r in records.read_records(spark, folder, records.shuffled(spark.read.parquet(index), 3)).collect()}
    assert len(ids) == len(rows)
    want = sorted([*whole("byte_bpe_50k.json", t or ""), 2] for _, t in rows)
    assert sorted(ids.values()) == want
    crcs = sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in want)
    assert sorted(r.ids_crc32 for r in found) == crcs


def test_a_changed_byte_is_found(spark, tmp_path):
    frame = records.frame(7, np.array([1, 2, 3], "<u2")) + b"\n"
    key, ids, end = records.unframe(memoryview(frame), 0)
    assert (key, ids.tolist(), end) == (7, [1, 2, 3], len(frame))
    for i in range(len(frame) - 1):
        broken = bytearray(frame)
        broken[i] ^= 1
        with pytest.raises(records.CorruptRecord):
            records.unframe(memoryview(bytes(broken)), 0)
    for end in range(len(frame)):
        with pytest.raises(records.CorruptRecord):
            records.unframe(memoryview(frame[:end]), 0)


def test_files_are_in_the_order_of_their_numbers(spark):
    names = [f"part-{n:05d}-q-c000.txt" for n in (0, 9, 99998, 99999, 100000, 1000001)]
    index = spark.createDataFrame([(0, 1, n, 0, 10**i, 0, name) for n, (i, name) in enumerate(enumerate(names))], records.INDEX_SQL)
    found = {r.doc_id: r.start for r in records.with_start(index).collect()}
    assert found == {n: sum(10**i for i in range(n)) for n in range(len(names))}


def test_empty_tables(spark, tmp_path):
    empty = frame_of(spark, [])
    records.write_records(empty, str(tmp_path / "r"), "byte_bpe_50k.json", 2)
    assert records.with_start(records.write_index(spark, str(tmp_path / "r"), str(tmp_path / "i"))).count() == 0
    assert packing.pack(empty, "word_bpe_49k.json", 1).count() == 0


def test_query_4_against_whole_encoding(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()}
    found = {r.doc_id: r for r in registered.op4_binary_records(spark, DOCS).collect()}
    assert found.keys() == docs.keys()
    start = 0
    for i in sorted(docs):
        ids = [*whole("byte_bpe_50k.json", docs[i] or ""), 2]
        assert (found[i].start, found[i].n_tokens, found[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def check_packing(rows, ids_of, window):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == ids_of.keys()
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids_of[doc])
            assert p.ids_crc32 == zlib.crc32(np.array(ids_of[doc][at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids_of[doc])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(by_sequence)


def test_query_6_against_whole_encoding(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()}
    ids_of = {i: [*whole("word_bpe_49k.json", t or ""), 1] for i, t in docs.items()}
    count = check_packing(registered.op6_differencing_pack(spark, DOCS).collect(), ids_of, 2048)
    assert count * 2048 <= 1.02 * sum(map(len, ids_of.values())) + 2048


def test_packing_small_windows_repeated_rows_and_nulls(spark):
    rows = [(i, "word " * (i * 7 % 60)) for i in range(80)] + [(80, None), (81, "")]
    out = packing.pack(frame_of(spark, rows, extra=True).coalesce(1), "word_bpe_49k.json", 1, window=16, piece=8, block=4).withColumn("ids_crc32", packing.checksums())
    check_packing(out.collect(), {i: [*whole("word_bpe_49k.json", t or ""), 1] for i, t in rows}, 16)
    twice = packing.pack(frame_of(spark, [(None, "a b"), (None, "a b")]), "word_bpe_49k.json", 1).collect()
    assert sum(r.length for r in twice) == 6


def test_differencing_is_level_and_near_the_best():
    rng = np.random.default_rng(3)
    for _ in range(300):
        sizes = rng.integers(1, 100, rng.integers(1, 60))
        k = int(rng.integers(1, 9))
        sums = np.bincount(packing.differencing(sizes, k), sizes, minlength=k)
        assert sums.sum() == sizes.sum() and len(sums) == k
        assert sums.max() - sums.min() <= sizes.max()
    # The known example: 8 7 6 5 4 into two sets leaves a difference of 2.
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4])) == [14, 16]
    assert np.bincount(packing.windows_of(np.array([5, 5, 5]), 8)).tolist() == [1, 1, 1]
