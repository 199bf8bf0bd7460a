"""Quality rules by distribution divergence: documents against references of their language.

A document has two histograms: its characters by class, and its words by the common words of its language, all other
words being one more bin. References are the same histograms of all documents of a language together. Documents whose
Jensen-Shannon distance to a reference passes a bound go, if they and the reference are long enough to tell.

Common words are those with at least a share ``COMMON`` of a language's words, so a language has at most 1 / COMMON.
They are found by pigeonhole: parts of a task's input hand on the words with half that share of the part, which bounds
what is shuffled. What these can come to leaves at most 2 / COMMON candidates a language, which are then counted over
all documents. Languages are labels of two or three letters, 18,278 at most, so what is sent to tasks has a bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import batch, text_or_empty
from hourgrid.session import staged

#: Least share of a common word.
COMMON = 0.005
#: Least words of a document, and least words and documents of a reference, for the distances to count.
LEAST_WORDS, REFERENCE_WORDS, REFERENCE_DOCUMENTS = 50, 10_000, 20
#: Greatest distances that pass, for characters and for words.
CHARACTERS, WORDS = 0.3, 0.45
#: The rule on repeated words: least words of a document, length of a window, percent of words in repeated windows.
FEWEST, RUN, REPEATED_PERCENT = 10, 5, 20
#: Bytes of text looked at together.
AT_ONCE = 6 << 20
#: Signs that count as symbols, and signs that are trimmed from the ends of a word.
SYMBOLS, TRIMMED = "#*$%&|<>", ".,;:!?\"'()[]{}"

#: Classes of characters, told by their first byte: 1 a-z, 2 A-Z, 3 digits, 4 white space, 5 symbols, 6 other signs,
#: 7 control, 8 to 10 characters of two, three and four bytes; 0 bytes behind the first.
CLASSES = 11


def class_of(b: int) -> int:
    c = chr(b)
    if b >= 0x80:
        return 0 if b < 0xC0 else 8 if b < 0xE0 else 9 if b < 0xF0 else 10
    if c in SYMBOLS:
        return 5
    return 4 if b == 0x20 or 9 <= b <= 13 else 7 if b < 0x20 or b == 0x7F else 3 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 6


CLASS_OF = np.array([class_of(b) for b in range(256)], np.uint8)


def bounds(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of large strings without nulls, and where each begins (and the last ends)."""
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def class_counts(column: pa.Array) -> np.ndarray:
    """Characters of each text by class (texts by CLASSES); column 0 is of no use."""
    data, ends = bounds(column)
    out = np.zeros((len(column), CLASSES), np.int64)
    kinds = CLASS_OF[data]
    sizes = np.diff(ends)
    for i in np.flatnonzero(sizes > AT_ONCE // 8):  # long texts one by one
        out[i] = np.bincount(kinds[ends[i] : ends[i + 1]], minlength=CLASSES)
    short = np.where(sizes > AT_ONCE // 8, 0, sizes)
    keep = np.repeat(sizes <= AT_ONCE // 8, sizes)
    cell = np.repeat(np.arange(len(column), dtype=np.int32) * CLASSES, short) + kinds[keep]
    return out + np.bincount(cell, minlength=len(column) * CLASSES).reshape(-1, CLASSES)


@dataclass
class Words:
    """The words of some texts: numbers of different words, the text of each word, and the different words."""

    code: np.ndarray
    text: np.ndarray
    different: pa.Array

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        pieces = pc.ascii_split_whitespace(column)
        text = np.asarray(pc.list_parent_indices(pieces))
        coded = pieces.flatten().dictionary_encode()
        filled = np.asarray(pc.greater(pc.binary_length(coded.dictionary), 0))
        code = np.asarray(coded.indices)
        some = filled[code] if len(code) else np.zeros(0, bool)
        return cls(code[some], text[some], coded.dictionary)

    def plain(self) -> tuple[np.ndarray, pa.Array]:
        """For each word the number of its plain form (a-z for A-Z, signs at the ends trimmed), and these forms."""
        forms = pc.utf8_trim(pc.ascii_lower(self.different), TRIMMED).dictionary_encode()
        return np.asarray(forms.indices)[self.code] if len(self.code) else self.code, forms.dictionary


def compact(numbers: np.ndarray) -> np.ndarray:
    """Other numbers, from 0, that are equal where these are."""
    return np.asarray(pa.array(numbers).dictionary_encode().indices).astype(np.int64)


def repeated_words(words: Words, texts: int, run: int = RUN) -> np.ndarray:
    """Words of each text that lie in a window of ``run`` words which its text has twice or more."""
    n = len(words.code) - run + 1
    if n <= 0:
        return np.zeros(texts, np.int64)
    # Windows grow by one word at a time; a window's number is exact, no hash.
    at = compact(words.text.astype(np.int64) * len(words.different) + words.code)
    window = at
    for k in range(1, run):
        window = compact(window[: len(at) - k] * len(at) + at[k:])
    whole = words.text[:n] == words.text[run - 1 :]
    times = np.bincount(window[whole], minlength=1)
    found = np.flatnonzero(whole)
    found = found[times[window[found]] > 1]
    marks = np.zeros(len(at) + 1, np.int64)
    np.add.at(marks, found, 1)
    np.add.at(marks, found + run, -1)
    return np.bincount(words.text[np.cumsum(marks[:-1]) > 0], minlength=texts)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that are equal to an earlier one."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def parts(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of a batch in parts of bounded bytes (or one long text), each with its texts."""
    sizes = np.cumsum(np.asarray(pc.binary_length(b.column("text"))))
    at = 0
    while at < len(b):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, side="right")))
        part = b.slice(at, end - at)
        yield part, part.column("text").cast(pa.large_string())
        at = end
        del part
        pa.default_memory_pool().release_unused()


def languages_of(part: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
    coded = part.column("lang").dictionary_encode()
    return coded.dictionary.to_pylist(), np.asarray(coded.indices)


CANDIDATES = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("words", pa.int64())])
COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
#: Names that stand for the classes and totals among the counted words; plain words have no white space.
CLASS_NAMES = [f" {c}" for c in range(CLASSES)]
DOCUMENTS, TOTAL = " documents", " words"


def by_language(words: Words, of_text: np.ndarray, names: list[str]) -> Iterator[tuple[int, np.ndarray, pa.Array]]:
    """For each language: its number, times of each plain form, and the forms; forms without a character do not count."""
    code, forms = words.plain()
    lang = of_text[words.text] if len(code) else code
    filled = np.asarray(pc.greater(pc.binary_length(forms), 0))
    for i in range(len(names)):
        times = np.bincount(code[lang == i], minlength=len(forms))
        yield i, np.where(filled, times, 0) if len(forms) else times, forms


def proposing(share: float):
    """Words with half the share of a part's words of a language, and the totals by which they are judged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in parts(b):
                names, of_text = languages_of(part)
                for i, times, forms in by_language(Words.of(texts), of_text, names):
                    total = int(times.sum())
                    at = np.flatnonzero((times > 0) & (times >= share / 2 * total))
                    found = [*forms.take(pa.array(at)).to_pylist(), TOTAL]
                    yield batch(CANDIDATES, lang=[names[i]] * len(found), word=found, n=[*times[at].tolist(), total], words=[total] * len(found))

    return run


def counting(candidates: dict[str, pa.Array]):
    """Counts of the candidates, of classes of characters, of words and of documents, by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in parts(b):
                names, of_text = languages_of(part)
                classes = class_counts(texts)
                for i, times, forms in by_language(Words.of(texts), of_text, names):
                    at = pc.index_in(candidates.get(names[i], pa.array([], pa.large_string())), value_set=forms)
                    met = at.is_valid()
                    own = candidates[names[i]].filter(met).to_pylist() if names[i] in candidates else []
                    n = times[np.asarray(at.filter(met))].tolist() if own else []
                    word = [*own, *CLASS_NAMES, TOTAL, DOCUMENTS]
                    n = [*n, *classes[of_text == i].sum(axis=0).tolist(), int(times.sum()), int((of_text == i).sum())]
                    yield batch(COUNTS, lang=[names[i]] * len(word), word=word, n=n)

    return run


@dataclass(frozen=True)
class Reference:
    words: pa.Array
    #: Shares of these words, and last of all others; shares of the classes of characters.
    word_shares: np.ndarray
    class_shares: np.ndarray


def label(lang: str = "lang") -> Column:
    """Two or three letters, in any case, with or without a region; else ''."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(lang).cast("string"), F.lit("")), r"^\s*([A-Za-z]{2,3})(?:[-_].*)?$", 1))


def references(docs: DataFrame, text: str = "text", lang: str = "lang", share: float = COMMON, least_words: int = REFERENCE_WORDS, least_documents: int = REFERENCE_DOCUMENTS) -> dict[str, Reference]:
    """The reference of each language that has enough words and documents. Rows without a label take no part.

    What comes to the driver are at most 2 / share words of each label (18,278 labels at most), whatever the input.
    """
    rows = docs.select(label(lang).alias("lang"), text_or_empty(text).alias("text")).where("lang <> ''")
    proposed = staged(rows.mapInArrow(proposing(share), "lang string, word string, n long, words long").groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("words").alias("words")))
    totals = proposed.where(F.col("word") == TOTAL).select("lang", F.col("n").alias("all_words"))
    # Parts that did not hand a word on have it less than share / 2 times their words.
    most = F.col("n") + F.lit(share / 2) * (F.col("all_words") - F.col("words"))
    able = proposed.where(F.col("word") != TOTAL).join(totals, "lang").where(most >= F.lit(share) * F.col("all_words") * (1 - 1e-9)).select("lang", "word").toArrow()
    groups: dict[str, list[str]] = {}
    for lang_name, word in zip(able.column("lang").to_pylist(), able.column("word").to_pylist(), strict=True):
        groups.setdefault(lang_name, []).append(word)
    candidates = {k: pa.array(sorted(v), pa.large_string()) for k, v in groups.items()}
    counted = rows.mapInArrow(counting(candidates), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    found: dict[str, dict[str, int]] = {}
    for lang_name, word, n in zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        found.setdefault(lang_name, {})[word] = n
    return {k: r for k, v in found.items() if v[TOTAL] >= least_words and v[DOCUMENTS] >= least_documents and (r := reference(v, share))}


def reference(counts: dict[str, int], share: float = COMMON) -> Reference:
    total = counts[TOTAL]
    words = sorted(w for w, n in counts.items() if not w.startswith(" ") and n >= share * total)
    shares = np.array([counts[w] for w in words] + [total - sum(counts[w] for w in words)]) / total
    classes = np.array([counts[c] for c in CLASS_NAMES], np.float64)
    classes[0] = 0
    return Reference(pa.array(words, pa.large_string()), shares, classes / classes.sum())


def distances(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, 0 to 1, of each row of counts to shares; rows without a count have 0."""
    total = counts.sum(axis=1, keepdims=True)
    p = counts / np.maximum(total, 1)
    m = (p + shares) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0.0).sum(axis=1)
        b = np.where(shares > 0, shares * np.log2(shares / m), 0.0).sum(axis=1)
    return np.where(total[:, 0] > 0, np.sqrt(np.clip((a + b) / 2, 0, 1)), 0.0)


JUDGED = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "plain_words")] + [("character_distance", pa.float64()), ("word_distance", pa.float64())])
JUDGED_SQL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, plain_words long, character_distance double, word_distance double"


def measuring(known: dict[str, Reference]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, texts in parts(b):
                n = len(part)
                words = Words.of(texts)
                classes = class_counts(texts)
                names, of_text = languages_of(part)
                code, forms = words.plain()
                real = np.asarray(pc.greater(pc.binary_length(forms), 0))[code] if len(code) else np.zeros(0, bool)
                plain = np.bincount(words.text[real], minlength=n)
                by_character, by_word = np.full(n, np.nan), np.full(n, np.nan)
                for i, name in enumerate(names):
                    if name not in known:
                        continue
                    r, own = known[name], np.flatnonzero(of_text == i)
                    by_character[own] = distances(classes[own][:, 1:], r.class_shares[1:])
                    bins = len(r.word_shares)
                    place = np.asarray(pc.fill_null(pc.index_in(forms, value_set=r.words), bins - 1)).astype(np.int64)
                    row = np.full(n, -1)
                    row[own] = np.arange(len(own))
                    mine = real & (row[words.text] >= 0) if len(code) else real
                    cells = np.bincount(row[words.text[mine]] * bins + place[code[mine]], minlength=len(own) * bins)
                    by_word[own] = distances(cells.reshape(-1, bins), r.word_shares)
                yield batch(
                    JUDGED,
                    doc_id=part.column("doc_id"), n_words=np.bincount(words.text, minlength=n), word_chars=classes[:, 1:].sum(axis=1) - classes[:, 4], n_symbols=classes[:, 5],
                    n_dup_lines=[repeated_lines(t.as_buffer().to_pybytes()) for t in texts], n_repeat_words=repeated_words(words, n), plain_words=plain,
                    character_distance=pa.array(by_character, from_pandas=True), word_distance=pa.array(by_word, from_pandas=True),
                )

    return run


def judge(docs: DataFrame, known: dict[str, Reference], key: str = "doc_id", text: str = "text", lang: str = "lang", characters: float = CHARACTERS, words: float = WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Measures of every row, base_failed, too_far (by the method, if there are enough words) and kept; nothing is shuffled.

    A text without a reference of its language has null distances and passes the method; so do texts of fewer than
    ``least_words`` plain words. Null texts are empty, repeated rows are judged one by one, no rows give none.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), label(lang).alias("lang"), text_or_empty(text).alias("text"))
    found = rows.mapInArrow(measuring(known), JUDGED_SQL)
    base = (F.col("n_words") < FEWEST) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))
    far = (F.col("plain_words") >= least_words) & ((F.coalesce("character_distance", F.lit(0.0)) > characters) | (F.coalesce("word_distance", F.lit(0.0)) > words))
    return found.withColumn("base_failed", base).withColumn("too_far", far).withColumn("kept", ~(F.col("base_failed") | F.col("too_far")))
