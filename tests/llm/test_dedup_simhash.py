from __future__ import annotations

import hashlib
import itertools
import os
import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hourgrid.llm import components, exact_dedup, registered, simhash

DOCS = "/root/testdata/sf0.001"


def written(spark, tmp_path, rows, schema="doc_id long, text string"):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    return path


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    out = []
    for i, t in rows:
        group = [(j is None, j or 0) for j, u in rows if norm(u) == norm(t)]
        least = min(group)
        out.append((i, None if least[0] else least[1], len(group), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


ODD = [(7, "a  b"), (3, "a\tb"), (9, "a b "), (None, "a b"), (4, None), (6, ""), (5, " "), (1, " a b"), (2, "x" * 200000), (8, "x" * 200000), (3, "a\tb"), (None, "only"), (None, "only")]


def test_dedup_with_nulls_repeats_and_long_texts(spark, tmp_path):
    out = exact_dedup.deduplicate(spark, written(spark, tmp_path, [(*r, 1, "f", 0) for r in ODD], "doc_id long, text string, row int, file string, id int")).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.digest.hex()) for r in out), key=repr) == expected(ODD)
    kept = [r for r in out if r.kept]
    assert len(kept) == len({norm(t) for _, t in ODD})
    assert all(r.id == r.keep_id for r in kept)


def test_state_goes_on_over_rounds_and_runs(spark, tmp_path):
    path, state = tmp_path / "in", str(tmp_path / "state")
    for n, part in enumerate([ODD[:4], ODD[4:9], ODD[9:]]):
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(path))
        if n:  # a run over what has arrived so far, a file a round; the state stays for the next run
            out = exact_dedup.deduplicate(spark, str(path), state_folder=state, round_bytes=1).collect()
    assert sorted(((r.id, r.keep_id, r.group_size, r.digest.hex()) for r in out), key=repr) == expected(ODD)


def test_a_later_call_takes_in_files_that_are_older(spark, tmp_path):
    path, state = tmp_path / "in", str(tmp_path / "state")
    for part, days in ((ODD[:6], 0), (ODD[6:], 400)):
        met = set(path.glob("part-*")) if path.exists() else set()
        spark.createDataFrame(part, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(path))
        for file in set(path.glob("part-*")) - met:
            os.utime(file, (time.time() - days * 86400,) * 2)
        before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
        out = exact_dedup.deduplicate(spark, str(path), state_folder=state).collect()
        assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    assert sorted(((r.id, r.keep_id, r.group_size, r.digest.hex()) for r in out), key=repr) == expected(ODD)


def test_equal_digests_of_different_contents_are_told_apart(spark, tmp_path):
    rows = [(i, t) for i, t in ODD if i is not None] + [(11, "zz"), (12, "zy")]
    weak = F.unhex(F.hex(F.substring(exact_dedup.normalised(), 1, 1).cast("binary")))
    out = exact_dedup.deduplicate(spark, written(spark, tmp_path, rows), digest_of=weak).collect()
    assert sorted(((r.id, r.keep_id, r.group_size) for r in out), key=repr) == sorted((e[:3] for e in expected(rows)), key=repr)


def test_dedup_of_an_empty_table(spark, tmp_path):
    assert exact_dedup.deduplicate(spark, written(spark, tmp_path, [])).count() == 0


def fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, radius=3):
    prints = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, f"{p:016x}", least.get(find(i))) for i, ((doc, _), p) in enumerate(zip(rows, prints, strict=True))), key=repr)


TEXTS = [(1, ""), (2, None), (3, " \t"), (4, "One Two"), (5, "one two"), (None, "one two"), (6, "ÀB ß c d"), (7, "w " * 50000), (5, "one two"), (8, "a b c"), (None, "unique words here")]


def test_simhash_with_nulls_repeats_and_long_texts(spark):
    base = [f"word{i}" for i in range(400)]
    near = [(20 + i, " ".join(base[: 380 + i])) for i in range(12)]
    rows = TEXTS + near
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, root int")
    out = simhash.near_duplicates(df).select("doc_id", simhash.hexadecimal(), "component_id").collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute(rows)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_query_8_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in registered.op8_simhash_positions(spark, DOCS).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("tile", [2, 7, 4096])
def test_links_connect_exactly_the_near_values(spark, tile):
    rng = np.random.default_rng(5)
    values = {int(x) for x in rng.integers(0, 1 << 63, 40, dtype=np.uint64)}
    for v in list(values)[:12]:  # chains and clusters, up to a few bits away
        for _ in range(8):
            v ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            values.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 3, tile)
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 3).count() == 0
    roots = {r.node: r.root for r in components.components(links).collect()}
    for a, b in itertools.combinations(signed, 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3:
            assert roots[a] == roots[b]


def test_every_three_positions_lie_in_a_set():
    sets = simhash.position_sets()
    assert len(sets) == 14
    assert all(any(set(t) <= set(s) for s in sets) for t in itertools.combinations(range(8), 3))
    assert all(tuple(sorted(set(range(8)) - set(s))) in sets for s in sets)


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(5, 5), (None, 3), (61, 60)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 40)} | {60: 60, 61: 60}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
