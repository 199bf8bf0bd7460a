"""License notices in texts: exact short phrases, and longer notices with errors.

Texts are reduced to words joined by single blanks. A notice that may differ by up to ``errors`` characters is split
into one part more than that: by the pigeonhole principle, a place with no more errors holds one of the parts unchanged.
All parts of all notices are sought at once by an Aho-Corasick automaton. Around each part that is found, the stretch
where the notice could lie is matched with the regex library, which bounds and counts the errors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourgrid.llm.common import batch, kept, text_or_empty

# The phrases whose places are counted, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Notices that may hold errors, and their labels.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license": "apache",
    "licensed under the apache license version 2 0": "apache",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "mit license": "mit",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "reserved",
}
#: Characters of a notice for one error that is let pass; notices shorter than the second number stand between whole words
#: and may have one error.
CHARS_AN_ERROR, SHORT = 12, 16

FOUND_SQL = "doc_id long, n_words long, matches array<struct<notice: string, label: string, exact_phrase: boolean, word: long, start: long, stop: long, errors: int, score: double>>"

#: Bytes of words: digits, letters (A-Z lowered) and all of non-ASCII characters; any other byte parts words.
WORD_BYTES = bytes((b | 0x20) if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def parts(notice: str, errors: int) -> list[tuple[int, str]]:
    """The notice in errors + 1 parts of like length, each with its place."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], chars_an_error: int):
        import ahocorasick
        import regex

        self.phrases, self.notices = phrases, notices
        self.errors = {n: len(n) // chars_an_error if len(n) >= SHORT else 1 for n in notices}
        # The best match in a stretch is wanted, not the first one within the bound.
        self.patterns = {}
        for n, e in self.errors.items():
            near = f"(?:{regex.escape(n, literal_spaces=True)}){{e<={e}}}"
            self.patterns[n] = regex.compile(f"(?b)(?<= ){near}(?= )" if len(n) < SHORT else f"(?b){near}")
        seeds: dict[str, list[tuple[str, int]]] = {}
        for n, e in self.errors.items():
            for at, part in parts(n, e):
                seeds.setdefault(part, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for part, users in seeds.items():
            self.automaton.add_word(part, (len(part), users))
        if seeds:
            self.automaton.make_automaton()
        self.seeds = bool(seeds)

    def phrase_places(self, words: str) -> Iterator[tuple[str, int]]:
        """``words``: each between single blanks, with a blank at both ends."""
        for phrase in self.phrases:
            wanted, at = f" {phrase} ", -1
            while (at := words.find(wanted, at + 1)) >= 0:
                yield phrase, at + 1

    def stretches(self, words: str) -> dict[str, list[list[int]]]:
        """For each notice, where it could lie: stretches around its parts, those that overlap joined."""
        found: dict[str, list[list[int]]] = {}
        if not self.seeds:
            return found
        for end, (length, users) in self.automaton.iter(words):
            for notice, at in users:
                e = self.errors[notice]
                a = max(0, end - length + 1 - at - e)
                b = min(len(words), a + len(notice) + 3 * e)
                found.setdefault(notice, []).append([a, b])
        for notice, spans in found.items():
            spans.sort()
            joined = [spans[0]]
            for a, b in spans[1:]:
                if a <= joined[-1][1]:
                    joined[-1][1] = max(b, joined[-1][1])
                else:
                    joined.append([a, b])
            found[notice] = joined
        return found

    def matches(self, pattern, words: str, a: int, b: int) -> Iterator:
        """All matches of a stretch, the best first: what stands before and behind a match is searched again."""
        left = [(a, b)]
        while left:
            a, b = left.pop()
            m = pattern.search(words, a, b) if a < b else None
            if m is not None and m.end() > m.start():
                yield m
                left += [(a, m.start()), (m.end(), b)]

    def near_places(self, words: str) -> Iterator[tuple[str, int, int, int]]:
        for notice, spans in self.stretches(words).items():
            pattern, step = self.patterns[notice], len(notice) + 2 * self.errors[notice]
            for a, b in spans:
                # Long joined stretches are matched in overlapping pieces; a match counts where it starts first.
                last = -1
                for at in range(a, b, step):
                    for m in sorted(self.matches(pattern, words, at, min(b, at + 2 * step)), key=lambda m: m.start()):
                        if m.start() > last and m.start() < at + step:
                            yield notice, m.start(), m.end(), sum(m.fuzzy_counts)
                            last = m.end() - 1

    def scan(self, text: bytes) -> tuple[int, list[dict]]:
        split = text.translate(WORD_BYTES).split()
        words = " " + b" ".join(split).decode(errors="replace") + " "
        out = []
        for phrase, at in self.phrase_places(words):
            out.append(dict(notice=phrase, label=self.phrases[phrase], exact_phrase=True, word=words.count(" ", 0, at) - 1, start=at - 1, stop=at - 1 + len(phrase), errors=0, score=1.0))
        for notice, a, b, errors in self.near_places(words):
            a += words[a] == " "  # a match may take in the blank before it
            out.append(dict(notice=notice, label=self.notices[notice], exact_phrase=False, word=words.count(" ", 0, a) - 1, start=a - 1, stop=b - 1, errors=errors, score=1 - errors / len(notice)))
        return len(split), out


def scanning(phrases: dict[str, str], notices: dict[str, str], chars_an_error: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept(("license scanner", repr((phrases, notices, chars_an_error))), lambda: Scanner(phrases, notices, chars_an_error))
        match = pa.struct([("notice", pa.string()), ("label", pa.string()), ("exact_phrase", pa.bool_()), ("word", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())])
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("matches", pa.list_(match))])
        for b in batches:
            counts, found = zip(*(scanner.scan(t.as_buffer().to_pybytes()) for t in b.column("text")), strict=True) if len(b) else ((), ())
            yield batch(schema, doc_id=b.column("doc_id"), n_words=counts, matches=found)

    return run


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES, chars_an_error: int = CHARS_AN_ERROR) -> DataFrame:
    """(doc_id, n_words, matches) of every row; nothing is shuffled.

    A match has its notice, label, whether it is an exact phrase, the number of its first word, its span in the words
    joined by blanks, its errors, and a score: the part of the notice that is unchanged. Null texts count as empty, rows
    with equal or null ids stay rows of their own, an empty table gives no rows.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    return rows.mapInArrow(scanning(phrases, notices, chars_an_error), FOUND_SQL)
