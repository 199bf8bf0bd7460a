"""Token ids of whole texts by a public tokenizer file, with each word encoded once in a Python worker.

Both kinds of vocabulary cut a text into words before any merge, so ids of a text are the ids of its words in a row.
Arrow splits a batch of texts and finds its different words; the ids of words that a worker has met are found in a store
of Arrow arrays, about 35 bytes a word. Words that are not there go to the tokenizer many to a string: their places in the
ids follow from the bytes that each id stands for. The store has a bound, beyond it the words not met for longest go; the
bound changes memory and time, never ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from hourgrid.llm.common import kept

#: Texts with a run of white space, or any besides blank and line feed, are encoded as one string.
UNSAFE = "[\\t\\r\\x0b\\x0c\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]|[ \\n][ \\n]"
#: Words whose bytes are as many in lower case and composed form as before: ASCII, composed Latin, Cyrillic, kana, Han and Hangul.
PLAIN = "^[!-~\u00a1-\u012f\u0131-\u017e\u0400-\u0482\u048a-\u04ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]+$"
#: Words remembered by one worker.
WORDS_KEPT = 300_000
#: Words encoded in one string.
JOINED = 4000
WORD_END = "</w>"
#: Bytes of text split at once.
AT_ONCE = 3 << 20


def binary_array(data: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """Stretches of bytes, each up to its end."""
    offsets = np.concatenate(([0], ends)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


class WordStore:
    """ids(texts): the token ids of each text in turn; encoded(texts): those of many texts in one array.

    A vocabulary says how texts are cut into words, which texts cannot be cut, and how words and whole texts are encoded.
    """

    dtype = np.dtype("<u4")
    unsafe = UNSAFE

    def __init__(self, words_kept: int = WORDS_KEPT):
        self.words_kept = words_kept
        self.round = 0
        self.known, self.known_ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())
        self.met = np.zeros(0, np.int64)

    def split(self, texts: pa.Array) -> pa.Array:
        raise NotImplementedError

    def encode_words(self, words: pa.Array) -> pa.Array:
        raise NotImplementedError

    def encodings(self, texts: list[str]) -> list[np.ndarray]:
        raise NotImplementedError

    def lookup(self, words: pa.Array) -> pa.Array:
        """Ids of different words."""
        self.round += 1
        at = np.asarray(pc.fill_null(pc.index_in(words, value_set=self.known), -1)).astype(np.int64) if len(self.known) else np.full(len(words), -1)
        new = at < 0
        self.met[at[~new]] = self.round
        both = self.known_ids
        if new.any():
            missing = words.filter(pa.array(new))
            at[new] = len(self.known) + np.arange(len(missing))
            both = pa.concat_arrays([self.known_ids, self.encode_words(missing)])
            self.remember(pa.concat_arrays([self.known, missing]), both, np.concatenate((self.met, np.full(len(missing), self.round))))
        return both.take(pa.array(at))

    def remember(self, words: pa.Array, ids: pa.Array, met: np.ndarray) -> None:
        if len(words) > self.words_kept:
            last = pa.array(np.sort(np.argsort(-met, kind="stable")[: self.words_kept]))
            words, ids, met = words.take(last), ids.take(last), met[np.asarray(last)]
        self.known, self.known_ids, self.met = words, ids, met

    def ids_by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.split(texts)
        first = np.asarray(pieces.offsets)
        coded = pieces.flatten().dictionary_encode()
        del pieces
        taken = self.lookup(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1]
        data = np.frombuffer(taken.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].view(self.dtype)
        return data, (ends[first - first[0]] - ends[0]) // self.dtype.itemsize

    def encoded(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Parts of the texts in turn: number of the first text, ids of the part, and where each text of it begins (and the last ends)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        sizes = np.cumsum(np.asarray(pc.binary_length(texts)))
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + AT_ONCE, side="right")))
            part = texts.slice(at, end - at)
            unsafe = np.asarray(pc.match_substring_regex(part, self.unsafe)) if self.unsafe else np.zeros(len(part), bool)
            data, starts = self.ids_by_word(pc.if_else(pa.array(unsafe), "", part) if unsafe.any() else part)
            if unsafe.any():
                whole = dict(zip(np.flatnonzero(unsafe).tolist(), self.encodings(part.filter(pa.array(unsafe)).to_pylist()), strict=True))
                runs = [whole.get(i, data[starts[i] : starts[i + 1]]).astype(self.dtype) for i in range(len(part))]
                data, starts = np.concatenate(runs), np.cumsum([0, *map(len, runs)])
            yield at, data, starts
            at = end
            del data, part
            pa.default_memory_pool().release_unused()

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text in turn; null counts as empty."""
        for _, data, starts in self.encoded(texts):
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                yield data[a:b]


class WordEncoder(WordStore):
    """Vocabularies of the tokenizers library."""

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        super().__init__(words_kept)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # The byte-level kind keeps white space as part of ids, so its words carry the blank before them.
        self.keeps_space = self.tokenizer.normalizer is None
        self.unsafe = UNSAFE if self.keeps_space else ""
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes that an id stands for: its entry has one character for each.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for entry, i in vocabulary.items():
            self.bytes_of[i] = len(entry.removesuffix(WORD_END))

    def encodings(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        return [ids.astype(self.dtype).tobytes() for ids in self.encodings(texts)]

    def alone(self, words: pa.Array) -> pa.Array:
        return pa.array(self.encode_whole(words.to_pylist()), pa.large_binary())

    def joined(self, words: pa.Array, between: str, between_ids: int) -> pa.Array:
        """Ids of words that are encoded in strings of many; ``between_ids``: ids (of one byte) that stand for ``between``."""
        starts = list(range(0, len(words), JOINED))
        offsets = pa.array([*starts, len(words)], pa.int32())
        strings = pc.binary_join(pa.ListArray.from_arrays(offsets, words.cast(pa.string())), between).to_pylist()
        out = []
        for at, ids in zip(starts, self.encodings(strings), strict=True):
            part = words.slice(at, JOINED)
            reach = np.cumsum(self.bytes_of[ids])
            wanted = np.cumsum(np.asarray(pc.binary_length(part)) + between_ids)
            wanted[-1] -= between_ids
            ends = np.searchsorted(reach, wanted) + 1
            if not len(ids) or ends[-1] != len(ids) or (reach[ends - 1] != wanted).any():
                out.append(self.alone(part))  # not as long as assumed
                continue
            if between_ids:
                stays = np.ones(len(ids), bool)
                stays[ends[:-1] - 1] = False
                ids = ids[stays]
                ends = ends - np.minimum(np.arange(1, len(ends) + 1), len(ends) - 1)
            out.append(binary_array(ids.astype(self.dtype).view(np.uint8), ends * self.dtype.itemsize))
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def encode_words(self, words: pa.Array) -> pa.Array:
        if self.keeps_space:
            empty = np.isin(np.asarray(pc.binary_length(words)), [0]) | np.asarray(pc.equal(words, "\n"))
            blank = np.asarray(pc.starts_with(words, " "))
            kinds = [(blank, "", 0), (~blank & ~empty, "\n", 1)]
        else:
            kinds = [(np.asarray(pc.match_substring_regex(words, PLAIN)), " ", 0)]
        places, parts, rest = [], [], np.ones(len(words), bool)
        for mask, between, between_ids in kinds:
            at = np.flatnonzero(mask)
            if len(at):
                places.append(at)
                parts.append(self.joined(words.take(pa.array(at)), between, between_ids))
                rest[at] = False
        at = np.flatnonzero(rest)
        places.append(at)
        parts.append(self.alone(words.take(pa.array(at))))
        back = np.empty(len(words), np.int64)
        back[np.concatenate(places)] = np.arange(len(words))
        return pa.concat_arrays(parts).take(pa.array(back))

    def split(self, texts: pa.Array) -> pa.Array:
        if self.keeps_space:
            texts = pc.replace_substring(pc.replace_substring(texts, " ", "\x1f "), "\n", "\x1f\n\x1f")
            return pc.split_pattern(texts, "\x1f")
        return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")


class PieceEncoder(WordStore):
    """Vocabularies of the sentencepiece library that put a blank before a text and let no piece reach over one.

    The words are those between single blanks, each of which is encoded with the blank before it.
    """

    #: Runs of blanks (a text has one before it) make pieces of their own; the sign for a blank is no blank.
    unsafe = "  |^ | $|^$|\u2581"

    def __init__(self, path: str, words_kept: int = WORDS_KEPT):
        super().__init__(words_kept)
        from sentencepiece import SentencePieceProcessor

        self.pieces = SentencePieceProcessor(model_file=path)
        size = self.pieces.get_piece_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        if any("\u2581" in self.pieces.id_to_piece(i).lstrip("\u2581") for i in range(size)):
            self.unsafe = "^"  # no text can be cut

    def encodings(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.pieces.encode(texts, num_threads=1)] if texts else []

    def encode_words(self, words: pa.Array) -> pa.Array:
        found = self.pieces.encode(words.to_pylist(), num_threads=1)
        data = np.fromiter(chain.from_iterable(found), self.dtype)
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) * self.dtype.itemsize
        return binary_array(data.view(np.uint8), ends)

    def split(self, texts: pa.Array) -> pa.Array:
        return pc.split_pattern(texts, " ")


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file."""
    return kept(("word encoder", path), lambda: WordEncoder(path))


def piece_encoder(path: str) -> PieceEncoder:
    return kept(("piece encoder", path), lambda: PieceEncoder(path))


def public_path(name: str) -> str:
    """Place of a public tokenizer file on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path(name)
