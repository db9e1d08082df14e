"""Fast exact encoding of large texts by a tokenizers file.

Both kinds of vocabulary cut a text at its white space before any merge, so a text's ids are
the ids of its white-space chunks in a row. Each Python worker keeps the chunks it has seen
and their ids; only new chunks meet the tokenizer, many joined into one text by a separator
that is a token of its own. The memory of a worker is bounded: once its table is full, new
chunks are encoded for the texts at hand and forgotten. Texts with characters on which the
white-space classes of Python and of the tokenizer differ are encoded directly.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np

#: Chunks a worker remembers, characters it encodes at a time, chunks joined into one text.
MOST_CHUNKS, AT_ONCE, JOINED = 700_000, 1_000_000, 64
#: White space to Python's str.split but not to the tokenizers, and the mark of a line's start.
_ODD = re.compile("[\0\x1c-\x1f]")
#: White space other than the space and the line end.
_RARE = re.compile("[\t\x0b-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: A word with the single space before it; all but the last of a run of white space; the last.
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")

_encoders: dict[tuple[str, bool], Callable] = {}


def _spaced_keys(text: str) -> list[str]:
    """Chunks of a text with their white space, as keys: a word with a space before it as the
    word alone, a line end as itself, all else after the mark."""
    if not _RARE.search(text):
        keys = ("\0" + text.replace("\n", " \n \0")).split(" ")
        if "" not in keys and "\0" not in keys:  # each white space stands alone between two words
            return keys
    return [c[1:] if c[0] == " " and len(c) > 1 and not c[1].isspace() else c if c == "\n" else "\0" + c for c in _SPACED.findall(text)]


def _spaced_chunk(key: str) -> str:
    return key[1:] if key[0] == "\0" else key if key == "\n" else " " + key


class _Chunks(dict):
    """Chunk -> place; a new chunk gets the next place and waits in ``new``."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        self.new.append(chunk)
        return place


class _Encoder:
    """keys: the chunks of a text, under keys that chunk_of reads back. separator: text that
    stands alone as one token between any two chunks without it."""

    def __init__(
        self, tokenizer: str, keys: Callable[[str], list[str]], chunk_of: Callable[[str], str], separator: str,
    ) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would each keep memory
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(tokenizer)
        self.model.encode_special_tokens = True  # their strings in a text are ordinary text
        self.keys, self.chunk_of, self.separator, self.mark = keys, chunk_of, separator, separator.strip(" ")
        [self.mark_id] = self.ids_of([self.mark])[0]
        self.chunks = _Chunks()
        self.pool, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)  # ids of place p: pool[ends[p]:ends[p + 1]]

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def learn(self) -> None:
        """Append the ids of the new chunks to the pool."""
        new, self.chunks.new = list(map(self.chunk_of, self.chunks.new)), []
        alone = [i for i, c in enumerate(new) if self.mark in c or c.isspace()]
        apart = set(alone)
        joint = [i for i in range(len(new)) if i not in apart] if alone else list(range(len(new)))
        groups = [joint[at:at + JOINED] for at in range(0, len(joint), JOINED)]
        runs = self.ids_of([self.separator.join([new[i] for i in g]) + self.separator for g in groups])
        flat = np.fromiter(chain.from_iterable(runs), np.int32, sum(map(len, runs)))
        marks = np.flatnonzero(flat == self.mark_id)
        sizes = np.zeros(len(new), np.int64)
        sizes[joint] = np.diff(marks, prepend=-1) - 1
        ids = flat[flat != self.mark_id]
        if alone:
            single = self.ids_of([new[i] for i in alone])
            sizes[alone] = [len(x) for x in single]
            starts = np.cumsum(sizes) - sizes
            whole = np.empty(int(sizes.sum()), np.int32)
            held = np.ones(len(whole), bool)
            for i, x in zip(alone, single, strict=True):
                whole[starts[i]:starts[i] + sizes[i]] = x
                held[starts[i]:starts[i] + sizes[i]] = False
            whole[held] = ids
            ids = whole
        self.pool = np.concatenate([self.pool, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def forget(self, places: int) -> None:
        """Back to the first ``places`` chunks."""
        while len(self.chunks) > places:
            self.chunks.popitem()
        self.ends = self.ends[:places + 1]
        self.pool = self.pool[:self.ends[-1]]

    def together(self, texts: list[str]) -> list[np.ndarray]:
        before = len(self.chunks)
        odd = [i for i, t in enumerate(texts) if _ODD.search(t)]
        split = [self.keys(t) for t in texts]
        for i in odd:
            split[i] = []
        many = np.fromiter(map(len, split), np.int64, len(split))
        places = np.fromiter(map(self.chunks.__getitem__, chain.from_iterable(split)), np.int64, int(many.sum()))
        if self.chunks.new:
            self.learn()
        starts = self.ends[places]
        sizes = self.ends[places + 1] - starts
        ends = np.cumsum(sizes)
        flat = self.pool[np.repeat(starts - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        cuts = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(many)])]
        out = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in odd:
            out[i] = np.array(self.ids_of([texts[i]])[0], np.int32)
        if before >= MOST_CHUNKS:  # full: what these texts added goes again
            self.forget(before)
        return out

    def __call__(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        waiting: list[str] = []
        size = 0
        for text in texts:
            waiting.append(text)
            size += len(text)
            if size >= AT_ONCE:
                yield from self.together(waiting)
                waiting, size = [], 0
        if waiting:
            yield from self.together(waiting)


def _kept(tokenizer: str, spaced: bool) -> _Encoder:
    """One encoder for each file in a Python worker, which Spark uses for many tasks."""
    if (tokenizer, spaced) not in _encoders:
        _encoders[tokenizer, spaced] = _Encoder(tokenizer, *((_spaced_keys, _spaced_chunk, "\n") if spaced else (str.split, str, " \0 ")))
    return _encoders[tokenizer, spaced]


def forget() -> None:
    """Forgets the chunks of this Python worker, for tasks that leave memory to what runs there next."""
    _encoders.clear()


def word_encoder(tokenizer: str) -> Callable[[Iterable[str]], Iterator[np.ndarray]]:
    """Texts -> int32 ids, for a vocabulary that drops white space."""
    return _kept(tokenizer, False)


def byte_encoder(tokenizer: str) -> Callable[[Iterable[str]], Iterator[np.ndarray]]:
    """Texts -> int32 ids, for a byte-level vocabulary that keeps white space in its tokens."""
    return _kept(tokenizer, True)
