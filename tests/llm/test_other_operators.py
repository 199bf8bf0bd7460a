from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hourgrid.llm import language, licenses, lines, mixing, registered, sharding, topk
from tests.check_oracle import compare, database
from tests.llm.test_near_texts import near_copies

DOCS = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registered.ORACLE))
def test_queries_match_sql(spark, name):
    assert compare(spark, database(DOCS), DOCS, name).startswith("ok")


# --- top-k


def brute_top(rows, k):
    fine = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, w in {q: w for q, w in fine if q % 50 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(w, v, strict=False)), i) for i, v in fine if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(1, 2), (3, 5), (256, 8192)])
def test_top_k_with_ties_nulls_ragged_and_sparse_vectors(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) if rng.random() < 0.4 else 0.0 for x in rng.integers(-2, 3, 6) / 4]) for i in range(0, 160, 5)]
    rows += [(1, None), (2, [None, 1.0]), (3, [float("nan")]), (4, [float("inf")]), (6, [1.0]), (7, []), (None, [1.0]), (11, [0.25] * 6), (11, [0.25] * 6)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, score int, qb int").repartition(3)
    out = topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_block=blocks[0], row_block=blocks[1])
    assert sorted(tuple(r) for r in out.collect()) == brute_top(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).count() == 0


# --- sharding


def check_shards(rows, shards):
    by_text, slots = {}, {}
    for r in rows:
        by_text.setdefault(r.digest, set()).add(r.shard)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(slots) <= set(range(shards))


def test_query_10_balances_bytes_and_keeps_groups(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = registered.op10_vector_shards(spark, "/root/testdata/sf0.01").withColumn("digest", F.col("text_crc32")).collect()
    check_shards(found, 8)
    load = Counter()
    for r in found:
        text = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        load[r.shard] += r.size
    assert len(found) == len(docs) and max(load.values()) / min(load.values()) < 1.02


def test_shards_with_hot_group_nulls_and_small_blocks(spark):
    rows = [(i, "hot text") for i in range(300)] + [(1000 + i, f"t {i} " + "x" * (i % 37)) for i in range(600)] + [(None, None), (None, ""), (5, "hot text"), (9999, "long " * 50000)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, shard int, digest string")
    out = sharding.shard(df, 4, block_groups=50, rows_a_part=100).collect()
    assert len(out) == len(rows)
    check_shards(out, 4)
    # The rest of the rows and bytes is levelled around the two large groups.
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) <= 320
    assert sharding.shard(df.limit(0), 4).count() == 0


# --- licenses

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def base(text):
    words = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, licenses.PHRASES[p]) for p in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_query_7_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = registered.op7_license_scan(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(docs)
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(docs[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def edits(a, b):
    """Least errors of ``a`` against any stretch of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_places_side_by_side_and_short_notices():
    scanner = licenses.Scanner(licenses.PHRASES, licenses.NOTICES, licenses.CHARS_AN_ERROR)
    places = lambda t: [(m["label"], m["word"], m["errors"]) for m in scanner.scan(t.encode())[1] if not m["exact_phrase"]]
    assert places("gnu genral public license gnu general public license") == [("gpl", 0, 1), ("gpl", 4, 0)]
    assert places("All right reserved; all rights reserved. Al rights reserved") == [("reserved", 0, 1), ("reserved", 3, 0), ("reserved", 6, 1)]
    assert places("apache licence, MIT licence") == [("apache", 0, 1), ("mit", 2, 1)]
    assert places("a permit license limit license") == []


def test_notices_with_errors_are_found_exactly_up_to_the_bound(spark):
    rng = np.random.default_rng(2)
    scanner = licenses.Scanner({}, licenses.NOTICES, licenses.CHARS_AN_ERROR)
    for notice, bound in scanner.errors.items():
        for changes in range(bound + 3):
            text = list(notice)
            for _ in range(changes):
                at = int(rng.integers(len(text)))
                kind = rng.integers(3)
                text[at : at + (kind != 0)] = ["q"] if kind < 2 else []
            words = "pre " * 5 + "".join(text) + " post" * 5
            padded = " " + " ".join(words.split()) + " "
            found = {n for n, *_ in scanner.near_places(padded)}
            assert (notice in found) == (edits(notice, padded) <= bound), (notice, padded)


def test_license_cases(spark):
    rows = [(1, None), (2, ""), (None, "CC-BY cc, by"), (3, "Apache License" + " x" * 100000), (3, "apache LICENSE"), (4, "gnu general public license mit license"), (5, "ccby cc byx éapache license")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, matches int")
    out = licenses.scan(df).collect()
    for (doc, text), r in zip(sorted(rows, key=repr), sorted(out, key=lambda r: repr((r.doc_id, dict(rows).get(r.doc_id)))), strict=True):
        exact = [m for m in r.matches if m.exact_phrase]
        assert r.doc_id == doc and (doc == 3 or (r.n_words, len(exact)) == base(text)[:2])
    assert licenses.scan(df.limit(0)).count() == 0


# --- mixing


def test_rake_meets_the_targets_and_rates_the_shares(spark):
    rows = [(s, l, t, (len(s) + 2) * (ord(l) - 90) * 10 + int(t) * 7) for s in ("a", "bb", "ccc") for l in "xyz" for t in "123"]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, observed long")
    targets = {"source": {"a": 0.5, "bb": 0.3, "ccc": 0.2}, "lang": {"x": 0.6, "y": 0.1, "z": 0.3}, "topic": {"1": 0.2, "2": 0.2, "3": 0.6}}
    frames = {d: spark.createDataFrame(list(v.items()), f"{d} string, target double") for d, v in targets.items()}
    out = mixing.rates(mixing.rake(cells, frames, 24), 0.5).toPandas()
    for d, want in targets.items():
        got = (out["rate"] * out["observed"]).groupby(out[d]).sum()
        assert np.allclose((got / got.sum())[list(want)], list(want.values()), atol=1e-6)
    assert out["rate"].max() <= 1 + 1e-12
    # Raking keeps the ratios of ratios of the observed table.
    w = out.set_index(["source", "lang", "topic"])
    odds = lambda c: w[c]["a", "x", "1"] * w[c]["bb", "y", "1"] / (w[c]["a", "y", "1"] * w[c]["bb", "x", "1"])
    assert np.isclose(odds("weight"), odds("observed"))


def test_mix_cases(spark):
    rows = [(i, f"text {i} of a license" if i % 3 else "plain words here", None if i % 5 == 0 else "s1", "en" if i % 2 else None, 0) for i in range(400)] + [(None, None, None, None, 0), (7, "", "", "", 0), (7, "", "", "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, rate int")
    out = mixing.mix(docs, 0.5)
    assert out.count() == len(rows) and out.where("rate < 0 or rate > 1").count() == 0
    chosen = mixing.sample(docs, 0.5)
    assert chosen.columns == docs.columns and chosen.count() == out.where("chosen").count()
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.sample(docs.limit(0)).count() == 0


def test_mix_reaches_its_part_beside_a_tiny_source(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").select("doc_id", "text", "lang", "source")
    tiny = spark.createDataFrame([(10**6, "word " * 200, "xx", "tiny")], docs.schema)
    rows = mixing.described(docs.unionByName(tiny)).cache()
    rates = mixing.calibrated(rows, 0.6, 6, 0.75)
    out = rows.join(rates, list(mixing.DIMENSIONS)).toPandas()
    assert len(out) == 201 and out["rate"].between(0, 1).all()
    drawn, whole = out["rate"] * out["tokens"], out["tokens"].sum()
    assert abs(drawn.sum() / whole - 0.6) < 1e-6
    assert out.set_index("source")["rate"]["tiny"] > 0.5
    # Within the bounds the solution is a product of a factor for each value, and the targets of the last dimension hold.
    got, share = drawn.groupby(out["topic"]).sum() / drawn.sum(), out.groupby("topic")["tokens"].sum() / whole
    want = share**0.75 / (share**0.75).sum()
    assert np.allclose(got, want, atol=1e-6) or (want > share / 0.6).any()


# --- lines of sites


def test_boilerplate_cases(spark):
    pages = [(i, "h", ["menu", f"own {i}", "menu", "x" * 50000]) for i in range(6)] + [(6, "h", ["other"]), (6, "h", ["other"]), (None, None, None), (7, "few", ["menu"]), (8, "few", [])]
    df = spark.createDataFrame([(*p, "a") for p in pages], "page_id long, site string, ls array<string>, gone string")
    out = lines.drop_boilerplate(df, "page_id", F.col("site"), F.col("ls"), 0.5, 3).collect()
    assert len(out) == len(pages)
    for r in out:
        if r.host == "h" and r.page_id < 6:
            assert (r.lines, r.n_lines, r.n_dropped) == ([f"own {r.page_id}"], 4, 3)
        else:
            assert r.n_dropped == 0
    assert lines.drop_boilerplate(df.limit(0), "page_id", F.col("site"), F.col("ls")).count() == 0


# --- language


def test_language_on_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs.where("doc_id % 2 = 0"), sample_rows=100)
    none = F.lit(None).cast("string")
    rows = docs.where("doc_id % 2 = 1").select("text", none.alias("declared"), none.alias("suffix"), none.alias("host"), none.alias("domain"), "lang", "n_chars")
    out = language.identify(rows, model, ["lang", "n_chars"])
    right = out.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]
    assert right > 0.97


def test_language_evidence_and_cases(spark):
    texts = [("en", "the cat and the house of the king with the other"), ("de", "der hund und das haus von dem mann mit einer frau nicht")]
    model = language.fit(spark.createDataFrame([(i, t, l) for i in range(20) for l, t in texts], "doc_id long, text string, lang string"))
    assert model.languages == ("de", "en")
    rows = [(i, "der hund und das haus nicht", "de", "de", "www.a.de", "a.de", 1) for i in range(60)] + [(100 + i, "the house of the king", "en-GB", "uk", "b.uk", "b.uk", 1) for i in range(60)]
    rows += [(200, "in", "de", "de", "www.a.de", "a.de", 1), (201, "in", "en", "uk", "b.uk", "b.uk", 1), (202, "in", None, None, None, None, 1), (203, None, "de", "de", "www.a.de", "a.de", 1), (204, "123 !", "en", "", "", "", 1), (205, "der hund und das haus nicht " * 40000, "en", "uk", "b.uk", "b.uk", 1), (None, "", None, None, None, None, 1)]
    df = spark.createDataFrame(rows, "page_id long, text string, declared string, suffix string, host string, domain string, posterior int")
    out = {r.page_id: r for r in language.identify(df, model, ["page_id"]).collect()}
    assert len(out) == len(rows)
    assert (out[200].language, out[201].language, out[205].language) == ("de", "en", "de")
    assert [out[i].language for i in (203, 204, None)] == ["und"] * 3
    assert all(0 <= r.probability <= 1 + 1e-9 for r in out.values())
    assert language.identify(df.limit(0), model, ["page_id"]).count() == 0
    assert language.fit(spark.createDataFrame([(1, "a", None), (2, "b", "??")], "doc_id long, text string, lang string")) is None


def test_every_page_has_a_language(spark):
    out = registered.op2_language_fusion(spark, "/root/testdata/sf0.01")
    wrong = out.where("language <> declared").count()
    assert out.count() == 250 and wrong <= 5


def test_more_than_64_labels_are_fitted_and_a_label_without_a_model_is_kept(spark, monkeypatch):
    rng = np.random.default_rng(3)
    labels = [a + b for a in "abcdefgh" for b in "jklmnopqr"]  # 72, each with words of its own, the last in a script of its own
    words = {l: ["".join(rng.choice(list("aeioulnrstkm"), 6)) for _ in range(40)] for l in labels} | {labels[-1]: ["".join(chr(0x10A0 + int(c)) for c in rng.integers(0, 40, 6)) for _ in range(40)]}
    text = lambda l: " ".join(rng.choice(words[l], 60))
    docs = [(i * 100 + k, text(l), l, f"s{k % 3}") for i, l in enumerate(labels) for k in range(12 if i < 64 else 6)]
    own = "".join(chr(c) for c in range(0x0E01, 0x0E2E))
    docs += [(10**6, " ".join(own[i : i + 6] for i in range(0, 40, 3)) * 5, "th", "s1"), (10**6 + 1, "123 !", "th", "s1")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    model = language.fit(df)
    assert model.languages == tuple(sorted(labels)) and model.table is None
    stays = {r.doc_id for r in dict(corpus_pipeline.STAGES)["language"](spark, df, DOCS).collect()}
    assert stays == {d[0] for d in docs} - {10**6 + 1}
    rows = spark.createDataFrame([(l, text(l), None, None, None, None) for l in labels], "want string, text string, declared string, suffix string, host string, domain string")
    assert language.identify(rows, model, ["want"]).where("language <> want").count() == 0
    monkeypatch.setattr(language, "DENSE", 100)
    texts = [d[1].encode() for d in docs[::50]] + [b"", b"123"]
    for a, b in zip(language.score(model, texts), language.score(language.fit(df), texts), strict=True):
        assert np.allclose(a, b, rtol=1e-3, atol=1e-2)


# --- pipeline


def test_pipeline_stages_keep_columns_and_do_their_part(spark):
    docs = spark.read.parquet(f"{DOCS}/documents.parquet").withColumn("file", F.lit(1)).withColumn("_row", F.lit("x"))
    rows = docs.collect()
    extra = spark.createDataFrame([(10**6, "123", "en", "s", 3, 1, "x"), (10**6 + 1, None, None, None, None, 1, "x"), (None, "", None, None, None, 1, "x")], docs.schema)
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language"](spark, docs.unionByName(extra), DOCS)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == {r.doc_id for r in rows}
    second = stages["exact_dedup"](spark, docs, DOCS)
    least = {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text), r.doc_id)
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == set(least.values())
    third = stages["near_dedup"](spark, second, DOCS)
    kept = [(r.doc_id, r.text) for r in second.collect()]
    assert third.columns == docs.columns and {r.doc_id for r in third.collect()} == {i for i, _ in kept} - near_copies(kept)
    fourth = stages["mix"](spark, docs, DOCS)
    chosen = {r.doc_id for r in mixing.mix(docs).where("chosen").collect()}
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == chosen
    for stage in list(stages.values()):
        assert stage(spark, docs.limit(0), DOCS).count() == 0


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, DOCS)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    totals = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < totals <= 2048
