from __future__ import annotations

import functools
import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hourgrid.llm import alignment, registered

DOCS = "/root/testdata/sf0.001"
ODD = [
    "", " ", "\n", "a", " a", "a ", "a  b", "a\n\nb", "it's", "<|endoftext|>", "<s>x</s>", "▁a", "naïve 日本語 é", "😀😀", "\x00", "x" * 5000, "日本" * 400, None,
    "a b c", "<0x41>", "é", "aaa bbb " * 50, "1 22\t333\r\n4", "　x", "Ⅻ ﬁ ½",
]


@functools.cache
def tokenizers():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens_of(text):
    first, second = tokenizers()
    alphabet = alignment.byte_alphabet()
    a = [(i, bytes(alphabet[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
    whole = (" " + text).encode()
    return (a, b) if text and b"".join(x for _, x in a) == whole == b"".join(x for _, x in b) else ([], [])


def brute(rows):
    docs, holds = [], Counter()
    for doc, text in rows:
        a, b = tokens_of(text or "")
        ends_a, ends_b = (np.cumsum([len(x) for _, x in t]).tolist() for t in (a, b))
        groups, i, j = [], 0, 0
        for cut in sorted(set(ends_a) & set(ends_b)):
            to_i, to_j = ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1
            groups.append(([x for x, _ in a[i:to_i]], [x for x, _ in b[j:to_j]]))
            i, j = to_i, to_j
        docs.append((doc, len(a), len(b), groups))
        holds.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    best = Counter()
    for (x, _), n in holds.items():
        best[x] = max(best[x], n)
    out = []
    for doc, n_a, n_b, groups in docs:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        digest = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((doc, n_a, n_b, len(groups), len(links), sum(holds[p] == best[p[0]] for p in links), sum(holds[p] for p in links), digest))
    return sorted(out, key=repr), holds


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_11_against_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()]
    assert rows_of(registered.op11_token_alignment(spark, DOCS)) == brute(docs)[0]


@pytest.mark.parametrize("sizes", [(8 << 20, 2 << 20), (50, 20)])
def test_odd_texts_repeated_rows_and_clashing_names(spark, sizes):
    rows = [*enumerate(ODD), (None, "a b"), (3, "a"), (3, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("block", "places", "n_a", "pair")}).repartition(3)
    found, pairs = alignment.alignment(df, block_bytes=sizes[0], part_bytes=sizes[1])
    want, holds = brute(rows)
    assert rows_of(found) == want
    assert {(r.id_a, r.id_b): r.documents for r in pairs.collect()} == holds


def test_large_groups_long_texts_and_no_rows(spark, monkeypatch):
    a, b = alignment.sides("byte_bpe_50k.json", "piece_bpe_32k.model")
    import pyarrow as pa

    texts = ["ab cd " * 700 + "x" * 200, "日本語 naïve " * 300, "", "one"]
    column = pa.array(texts, pa.large_string())
    own, found = alignment.align(a, b, column)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 0)
    monkeypatch.setattr(alignment, "JOINED", 50)
    own_again, again = alignment.align(a, b, column)
    assert all(np.array_equal(x, y) for x, y in zip(own, own_again, strict=True))
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(zip(*(x.tolist() for x in again), strict=True))
    assert own[4] == [r[7] for r in brute(list(enumerate(texts)))[0]]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.alignment(empty)[0].count() == 0


def test_overlaps_are_all_pairs_that_share_a_byte():
    rng = np.random.default_rng(5)
    for _ in range(50):
        ends = [np.unique(np.append(rng.integers(1, 40, 12), 40)) for _ in range(2)]
        starts = [np.append(0, e[:-1]) for e in ends]
        found = alignment.overlaps(np.zeros(len(starts[0]), int), starts[0], np.zeros(len(starts[1]), int), starts[1])
        want = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1])) if max(starts[0][i], starts[1][j]) < min(ends[0][i], ends[1][j])}
        assert set(zip(*(x.tolist() for x in found), strict=True)) == want
