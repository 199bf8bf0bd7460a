from __future__ import annotations

import re
from collections import Counter
from itertools import permutations
from math import log2, sqrt

import pytest
from pyspark.sql import functions as F

from hourgrid.llm import divergence, filter_audit, registered

DOCS = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- interaction of filters


def fails(rows):
    least = {}
    for doc, _, text in rows:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    out = []
    for doc, lang, text in rows:
        text = text or ""
        words = WORD.findall(text)
        conditions = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": doc is not None and doc > least[text],
        }
        out.append((doc, lang or "", {k for k, v in conditions.items() if v}))
    return out


def brute_audit(rows, labels):
    out = {}
    marked = fails(rows)
    for part in {p for _, p, _ in marked}:
        own = [(d, f) for d, p, f in marked if p == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, x in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [d for d, f in own if x in f and not f & before]
                shapley[x] += len(gone)
                out[part, order, step] = [
                    sum(not f & (before | {x}) for _, f in own), len(gone), sum(x in f and bool(f & before) for _, f in own), sum(f == {x} for _, f in own),
                    sum((d, "good") in labels for d in gone), sum((d, "toxic") in labels for d in gone),
                ]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


TEXTS = ["", "word " * 120, " ".join(f"w{i}" for i in range(150)), " ".join(f"w{i}" for i in range(150)) + " #", "ABC " * 5, "É" * 30 + "AB", None, "x|y", "   "]


def test_audit_with_nulls_ties_repeats_and_clashing_names(spark):
    rows = [(i, ["en", None, "fr", ""][i % 4], TEXTS[i % len(TEXTS)]) for i in range(60)] + [(None, "en", "x|y"), (7, "en", "x|y"), (7, "en", "x|y")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({c: F.lit(1) for c in ("part", "fails", "digest", "least")}).repartition(4)
    labels = spark.createDataFrame([(i, i % 3 % 2, i % 5 % 2) for i in range(40)] + [(None, 1, 1), (0, None, None), (2, 1, 0)], "doc_id long, quality int, toxic int")
    says = {(i, k) for i in range(40) for k, v in (("good", i % 3 % 2), ("toxic", i % 5 % 2)) if v} | {(2, "good")}
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(filter_audit.labelled(filter_audit.failed(df), labels)).collect()}
    assert found == brute_audit(rows, says)
    empty = filter_audit.audit(filter_audit.labelled(filter_audit.failed(df.limit(0)), labels))
    assert empty.count() == 0


def test_values_add_up_and_other_numbers_of_filters(spark):
    marked = spark.createDataFrame([("p", f, bool(f & 1), bool(f & 2)) for f in range(8) for _ in range(f + 1)], "part string, fails int, good boolean, toxic boolean")
    rows = filter_audit.audit(marked, "XYZ").collect()
    assert len(rows) == 6 * 3
    values = {r.filter_order[r.step - 1]: r.shapley for r in rows}
    assert sum(values.values()) == 6 * sum(f + 1 for f in range(1, 8))


# --- distribution divergence


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def histogram(text):
    """Characters by class."""
    kinds = [("[a-z]", 1), ("[A-Z]", 2), ("[0-9]", 3), (r"[\x20\x09-\x0D]", 4), (r"[#*$%&|<>]", 5), (r"[\x00-\x1f\x7f]", 7), (r"[\x21-\x7e]", 6), ("[\u0080-߿]", 8), ("[ࠀ-￿]", 9), (".", 10)]
    return Counter(next(k for p, k in kinds if re.match(p, c, re.S)) for c in text)


def plain(text):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return [w for x in WORD.findall(text) if (w := x.translate(lower).strip(divergence.TRIMMED))]


def distance(p, q):
    n, m = sum(p.values()), sum(q.values())
    if not n:
        return 0.0
    half = lambda x, nx, y, ny: sum(v / nx * log2((v / nx) / ((v / nx + y[k] / ny) / 2)) for k, v in x.items() if v)
    return sqrt(max(0.0, (half(p, n, q, m) + half(q, m, p, n)) / 2))


def brute_distances(rows, share, least_words, least_documents):
    refs = {}
    for lang in {x for _, x, _ in rows}:
        own = [t or "" for _, x, t in rows if x == lang]
        words = Counter(w for t in own for w in plain(t))
        if re.fullmatch("[a-z]{2,3}", lang or "") and sum(words.values()) >= least_words and len(own) >= least_documents:
            common = {w for w, n in words.items() if n >= share * sum(words.values())}
            refs[lang] = common, Counter({w: words[w] for w in common}) + Counter({None: sum(n for w, n in words.items() if w not in common)}), sum((histogram(t) for t in own), Counter())
    out = {}
    for doc, lang, text in rows:
        found = (None, None)
        if lang in refs:
            common, by_word, by_class = refs[lang]
            mine = Counter(w if w in common else None for w in plain(text or ""))
            found = distance(histogram(text or ""), by_class), distance(mine, by_word)
        out[doc] = (len(plain(text or "")), *found)
    return out


def check(found, rows, share, least_words, least_documents):
    want = brute_distances(rows, share, least_words, least_documents)
    assert len(found) == len(rows)
    for doc, _, text in rows:
        r = found[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
        n, by_character, by_word = want[doc]
        assert r.character_distance == (None if by_character is None else pytest.approx(by_character, abs=2e-6))
        assert r.word_distance == (None if by_word is None else pytest.approx(by_word, abs=2e-6))
        far = n >= divergence.LEAST_WORDS and by_word is not None and (by_character > divergence.CHARACTERS or by_word > divergence.WORDS)
        assert r.kept == (not (r.base_failed or far))


def test_query_13_against_brute_force(spark):
    rows = [(r.doc_id, r.lang, r.text) for r in spark.read.parquet(f"{DOCS}/documents.parquet").collect()]
    found = {r.doc_id: r for r in registered.op13_language_divergence(spark, DOCS).collect()}
    check(found, rows, divergence.COMMON, divergence.REFERENCE_WORDS, divergence.REFERENCE_DOCUMENTS)


@pytest.mark.parametrize("at_once", [divergence.AT_ONCE, 60])
def test_divergence_of_odd_texts(spark, monkeypatch, at_once):
    monkeypatch.setattr(divergence, "AT_ONCE", at_once)
    odd = ["", None, "a b c d e a b c d e f", "x\n\nx\n x\nx", " é ÀB (word)... <<>> 12\x00\x7f", "one two three four five " * 12, "...", "😀 日本 " * 30, "The end. the End; THE!", "w " * 4000]
    rows = [(i, ["en", "fr", None, "english", "deu"][i % 5], odd[i % len(odd)]) for i in range(60)] + [(100 + i, "en", f"the end of the day is near the {i} sea and the land " * 9) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumns({c: F.lit(1) for c in ("word", "n", "words")}).repartition(3)
    known = divergence.references(df, share=0.05, least_words=30, least_documents=3)
    assert all(len(r.words) <= 20 for r in known.values())
    found = {r.doc_id: r for r in divergence.judge(df, known).collect()}
    check(found, rows, 0.05, 30, 3)


def test_divergence_without_rows_and_with_repeats(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert divergence.references(empty) == {} and divergence.judge(empty, {}).count() == 0
    twice = spark.createDataFrame([(1, "en", "a"), (1, "en", "a"), (None, None, None)], "doc_id long, lang string, text string")
    assert divergence.judge(twice, {}).count() == 3
