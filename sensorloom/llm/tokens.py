"""Token ids by the tokenizers library, each distinct chunk of a batch encoded once.

Both vocabularies split a text before they merge, and never across a space that
follows a character which is no white space. So a text is cut there, the chunks
of a batch are reduced to distinct ones (Arrow's hash table, exact), those go
through the tokenizer, and the ids are put together again. A chunk of Latin
letters and marks behind them is a word and its marks to both vocabularies; its
word goes to the tokenizer's model directly, once for all chunks that share it.
Where cutting could change the ids (a space beside other white space, rare separators) other
cuts or none are made; ``tests/llm/test_tokens.py`` compares with plain encoding.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sensorloom.llm.base import text_slices

#: Pieces (words, marks, other chunks) kept between batches of one worker; beyond it the store starts anew.
STORE_PIECES = 700_000
#: Bytes of text that are encoded together.
TOGETHER = 8_000_000
_SLICE = 20_000
_RUNS = re.compile(r"\s*\S+|\s+\Z")
_ODD = re.compile(r"[\x1c-\x1f\x85]")
#: A space beside other white space (RE2).
_BESIDE = r" [\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
#: A word and the marks behind it; no apostrophe, which may begin a suffix.
_SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
_encoders: dict[tuple[str, int], ChunkEncoder] = {}


class ChunkEncoder:
    def __init__(self, path: str, store: int | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.store = store or STORE_PIECES
        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens are ordinary text in a document.
        self.tokenizer.encode_special_tokens = True
        # Does a space belong to the token after it, or is it dropped? Does case matter?
        self.leads = bool(self.tokenizer.encode(" ", add_special_tokens=False).ids)
        self.lower = bool(self.tokenizer.normalizer) and self.tokenizer.normalizer.normalize_str("A") == "a"
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): level.pre_tokenize_str(c)[0][0] for c in map(chr, [32, *range(65, 91), *range(97, 123), *range(192, 256)])}
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {"": 0}  # nothing has no ids
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _words(self, pieces: list[str]) -> list[list[int]]:
        """Letters alone, with a space before them or without: by the model itself."""
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        return [[t.id for t in tokenize(piece.translate(letters))] for piece in pieces]

    def _others(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, pieces: list[str], coder) -> None:
        for lo in range(0, len(pieces), _SLICE):
            part = pieces[lo : lo + _SLICE]
            coded = coder(part)
            lengths = np.fromiter(map(len, coded), np.int64, len(coded))
            n, k, total = len(self.at), len(coded), int(lengths.sum())
            while self.used + total > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            while n + k > len(self.start):
                self.start = np.concatenate([self.start, np.zeros_like(self.start)])
                self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.pool[self.used : self.used + total] = np.fromiter(chain.from_iterable(coded), np.uint32, total)
            self.length[n : n + k] = lengths
            self.start[n : n + k] = self.used + np.cumsum(lengths) - lengths
            self.used += total
            self.at.update(zip(part, range(n, n + k), strict=True))

    def _places(self, chunks: list[str]) -> np.ndarray:
        """Where the ids of distinct chunks are: of the word (or whole chunk), and of the marks behind it."""
        # A word and a whole chunk are never the same text: a word is letters alone, such a chunk is not.
        firsts, marks, words, others = [], [], {}, {}
        for chunk, found in zip(chunks, map(_SIMPLE.fullmatch, chunks), strict=True):
            if found:
                word, mark = found.groups()
                if self.lower:
                    word = word.lower()
                words[word] = None
                firsts.append(word)
                marks.append(mark)
            else:
                others[chunk] = None
                firsts.append(chunk)
                marks.append("")
        others.update(dict.fromkeys(marks))
        known = self.at.keys()
        new, more = [p for p in words if p not in known], [p for p in others if p not in known]
        if len(self.at) + len(new) + len(more) > self.store and (new or more):
            self._clear()
            new, more = list(words), [p for p in others if p]
        self._learn(new, self._words)
        self._learn(more, self._others)
        place = np.empty((len(chunks), 2), np.int64)
        place[:, 0] = np.fromiter(map(self.at.__getitem__, firsts), np.int64, len(firsts))
        place[:, 1] = np.fromiter(map(self.at.__getitem__, marks), np.int64, len(marks))
        return place

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks one after the other, and how many each has."""
        places = places.reshape(-1)
        lengths = self.length[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.start[places] - ends + lengths, lengths) + np.arange(total)], lengths.reshape(-1, 2).sum(1)

    def _single(self, text: str) -> np.ndarray:
        """A text in which a single space is no safe place to cut."""
        if _ODD.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        chunks = _RUNS.findall(text)
        distinct = list(dict.fromkeys(chunks))
        of = dict(zip(distinct, self._places(distinct), strict=True))
        return self._gather(np.array([of[c] for c in chunks], np.int64))[0]

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (null: of none)."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        # Taken anew: Arrow treats slices that do not start at their buffer's first text wrongly.
        texts = pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = np.arange(len(texts))
        if self.leads:
            twice = np.asarray(pc.match_substring_regex(texts, _BESIDE))
            for i in np.flatnonzero(twice):
                out[i] = self._single(texts[int(i)].as_py())
            plain = plain[~twice]
        if not len(plain):
            return out
        pieces = pc.split_pattern(texts.take(pa.array(plain)), " ")
        bounds = np.asarray(pieces.offsets).astype(np.int64)
        bounds -= bounds[0]
        coded = pieces.flatten().dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64) * 2 + 1
        codes[bounds[:-1]] -= self.leads  # the first piece has no space before it
        size = 2 * len(coded.dictionary)
        seen = np.flatnonzero(np.bincount(codes, minlength=size))
        names = coded.dictionary.to_pylist()
        lead = " " if self.leads else ""
        place = np.zeros((size, 2), np.int64)
        place[seen] = self._places([lead * (k & 1) + names[k >> 1] for k in seen.tolist()])
        ids, lengths = self._gather(place[codes])
        ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
        for i, lo, hi in zip(plain.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out[i] = ids[lo:hi]
        return out


def encoder(path: str, store: int = 0) -> ChunkEncoder:
    """One for each worker process, vocabulary and size of the store (0: ``STORE_PIECES``)."""
    if (path, store) not in _encoders:
        _encoders[path, store] = ChunkEncoder(path, store)
    return _encoders[path, store]


def encoded(batches: Iterator[pa.RecordBatch], path: str, end: int, together: int = TOGETHER, store: int = 0):
    """Slices of the batches (about ``together`` bytes of text, one row at least), each with the ids of column ``text``, the end id behind them."""
    coder = encoder(path, store)
    tail = np.array([end], np.uint32)
    for part in text_slices(batches, most=together):
        yield part, [np.concatenate([ids, tail]) for ids in coder.encode(part.column("text"))]
