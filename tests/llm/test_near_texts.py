from __future__ import annotations

import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hourgrid.llm import near_texts


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate({i: 32 for i in (9, 10, 11, 12, 13)}).split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_copies(rows):
    """Ids of the rows that are not the smallest of their group, by comparing all pairs that share a shingle."""
    sets = {i: shingles(t) for i, t in rows}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s or {None}:
            holders[x].append(i)
    shared = Counter(p for own in holders.values() for p in combinations(sorted(own), 2))
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for (a, b), n in shared.items():
        if not sets[a] or n / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i for i in sets if root(i) != i}


def changed(rng, words, part):
    """The text with some runs of words replaced."""
    out = list(words)
    for _ in range(max(1, round(len(words) * part / 5))):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def corpus(seed=3):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(150):
        words = [rng.choice(common) for _ in range(rng.randrange(60, 500))]
        group = [words] + [changed(rng, words, rng.uniform(0.02, 0.2)) for _ in range(rng.randrange(4))]
        for w in group:
            rows.append((i, " ".join(w)))
            i += 1
    passage = [rng.choice(common) for _ in range(60)]
    rows += [(i + k, " ".join(passage + [rng.choice(common) for _ in range(40)])) for k in range(200)]  # share a passage, are no copies
    return rows


def test_copies_with_changed_words_are_found_and_others_stay(spark):
    rows = corpus()
    want = near_copies(rows)
    found = {r.doc_id for r in near_texts.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert len(want) > 100 and len(found & want) >= 0.95 * len(want) and not found - want


def test_large_group_of_copies_keeps_one(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(900)}" for _ in range(300)]
    rows = [(7, " ".join(words))] + [(10 + i, " ".join(changed(rng, words, 0.03))) for i in range(500)] + [(1000 + i, f"other text number {i} of many") for i in range(100)]
    gone = {r.doc_id for r in near_texts.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert gone == {r[0] for r in rows if 10 <= r[0] < 1000}


def test_nulls_repeats_ties_and_clashing_names(spark):
    a, b = "one two three four five six seven", "quite another text with more than five words"
    rows = [(5, a), (5, b), (5, a), (9, a.upper()), (None, a), (None, b + " "), (3, None), (4, ""), (None, " \n"), (6, "x"), (8, "X"), (2, "y"), (11, "long " * 50000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("mark", "node", "first", "fp")}).repartition(4)
    gone = near_texts.repeats(df).select("doc_id", "mark")
    left = df.withColumn("m", near_texts.mark()).join(gone.select(F.col("doc_id").alias("i"), F.col("mark").alias("k")), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("m") == F.col("k")), "left_anti")
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=repr)
    assert got == sorted([(5, a), (5, a), (5, b), (3, None), (6, "x"), (2, "y"), (11, "long " * 50000)], key=repr)
    assert near_texts.repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize("width", [1, 5])
def test_shingle_hashes_follow_words_only(width):
    texts = pa.array(["A b  c\td e F g", " a b c d e f g ", "g f e d c b a", "", "   ", "a b", "b a", "é É"], pa.large_string())
    hashes, counts = near_texts.shingles(texts, width)
    cuts = np.split(hashes, np.cumsum(counts)[:-1])
    assert cuts[0].tolist() == cuts[1].tolist() and len(cuts[0]) == 8 - width
    assert [len(c) for c in cuts[3:5]] == [0, 0]
    if width == 5:
        assert not set(cuts[0].tolist()) & set(cuts[2].tolist()) and len(cuts[5]) == 1 and cuts[5][0] != cuts[6][0]


def test_no_pair_at_the_similarity_is_left_out(spark):
    rng = random.Random(21)
    rows, passage = [], [f"p{i}" for i in range(30)]
    for g in range(500):
        words = [f"g{g}w{i}" for i in range(rng.randrange(20, 90))] + passage
        end = list(words)
        for k in range((len(words) - 4) // 9 - rng.randrange(3)):  # a shingle for each word changed at the start
            end[k] = f"new{g}x{k}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(end))]
    want = near_copies(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(want) > 400 and {r.doc_id for r in near_texts.repeats(df).collect()} == want


def test_lists_lose_no_pair_at_borders_of_batches():
    rng = random.Random(2)
    sets = {bytes([i]): sorted(rng.sample(range(60), 50)) for i in range(40)}
    rows = sorted((h, len(s), k, n) for n, s in sets.items() for k, h in enumerate(s[: 50 - 40 + 1]))
    columns = list(zip(*rows))
    t = pa.table({"h": pa.array(columns[0], pa.int64()), "size": pa.array(columns[1], pa.int32()), "place": pa.array(columns[2], pa.int32()), "node": pa.array(columns[3], pa.binary()), "root": pa.array(columns[3], pa.binary())})
    for size in (1, 7, 1000):
        found = {tuple(sorted(p)) for b in near_texts.pairs_of_lists(0.8)(iter(t.to_batches(max_chunksize=size))) for p in zip(*(c.to_pylist() for c in b.columns))}
        want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b]))}
        assert want and want <= found


def test_pairs_do_not_grow_with_the_square_of_copies(spark, monkeypatch):
    made, lists = [], near_texts.pairs_of_lists
    for copies in (20, 100):
        rng = random.Random(copies)
        rows = [(10**6 + i, " ".join(f"t{i}w{k}" for k in range(20))) for i in range(300)]
        for g in range(6):
            words = [f"g{g}w{i}" for i in range(120)]
            for k in range(copies):  # one half is near the others, the other half too far from all
                own = list(words)
                for at in rng.sample(range(5, 115), 1 if k % 2 else 6):
                    own[at] = f"new{rng.randrange(10**9)}"
                rows.append((1000 * g + k, " ".join(own)))
        count = spark.sparkContext.accumulator(0)

        def counted(similarity, count=count):
            def run(batches):
                for b in lists(similarity)(batches):
                    count.add(b.num_rows)
                    yield b

            return run

        monkeypatch.setattr(near_texts, "SAMPLE", 10)
        monkeypatch.setattr(near_texts, "pairs_of_lists", counted)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert {r.doc_id for r in near_texts.repeats(df).collect()} == near_copies(rows)
        made.append(count.value)
    assert made[1] <= 7 * max(made[0], 100), made
