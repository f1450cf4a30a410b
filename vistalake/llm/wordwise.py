"""Tokenizers applied word by word.

Both public tokenizers used here cut a text at white space before they merge: no token spans the end of
a word and the space after it. So the tokens of a text are those of its words, and a word needs
to be encoded once in a worker process. The memo is bounded; long words go past it.

Worker processes live on between tasks and stages: forget() and light() hand back what the next ones don't need.
"""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from vistalake.llm import kernel

MEMO_WORDS = 800_000
LONGEST = 64


class PieceCounter:
    """Token counts of a sentencepiece model without normalisation, with a leading space and no merge over a space's left side."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.memo: dict[str, int] = {}

    def _encode(self, words: list[str]) -> list[int]:
        # the model puts the space before each word itself
        return [len(x) for x in self.model.encode(words, num_threads=1)]

    def counts(self, texts: list[str]) -> list[int]:
        plain = [t.replace("▁", " ") for t in texts]
        # only single spaces between words: the words alone decide
        parts = [t.split(" ") for t in plain]
        simple = ["" not in p for p in parts]
        new = set().union(*[p for p, ok in zip(parts, simple, strict=True) if ok]) - self.memo.keys()
        if len(self.memo) + len(new) > MEMO_WORDS:
            self.memo.clear()
            new = set().union(*[p for p, ok in zip(parts, simple, strict=True) if ok])
        words = list(new)
        local = dict(zip(words, self._encode(words), strict=True))
        self.memo.update((w, n) for w, n in local.items() if len(w) <= LONGEST)
        get = self.memo.get
        out = []
        for p, ok, t in zip(parts, simple, plain, strict=True):
            if ok:
                out.append(sum([get(w) or local[w] for w in p]))
            else:
                out.append(len(self.model.encode(t)))
        return out


class WordEncoder:
    """Ids of a ``tokenizers`` file whose pre-tokens hold no white space and part letters from marks."""

    #: Words encoded in one call, with a special token between them.
    JOINED = 512
    #: Calls of that size whose results, many times as large as the ids in them, are held at once.
    TOGETHER = 8
    #: Words after which the memo begins anew.
    MEMO = 400_000

    def __init__(self, path: str, between: str = "<|endoftext|>"):
        # a task has one core; the library's threads, one for each core of the machine, would each keep memory of their own
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.between, self.between_id = between, self.model.token_to_id(between)
        self._reset()

    def _reset(self) -> None:
        self.memo: dict[bytes, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.n_ids = 0
        self.begin = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int32)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one word after the other, and how many each has; words in which the special token may stand come without others."""
        odd = [b"<|" in w for w in words]
        plain = [w for w, o in zip(words, odd, strict=True) if not o]
        glue = self.between.encode()
        groups = [glue.join(plain[at : at + self.JOINED]).decode() + self.between for at in range(0, len(plain), self.JOINED)]
        some = [np.zeros(0, np.int32)]
        for at in range(0, len(groups), self.TOGETHER):
            found = self.model.encode_batch_fast(groups[at : at + self.TOGETHER], add_special_tokens=False)
            some.append(np.fromiter(chain.from_iterable(e.ids for e in found), np.int32))
        ids = np.concatenate(some)
        ends = np.flatnonzero(ids == self.between_id)
        n = np.diff(ends, prepend=-1) - 1
        ids = np.delete(ids, ends)
        if len(plain) == len(words):
            return ids, n
        alone = [e.ids for e in self.model.encode_batch_fast([w.decode() for w, o in zip(words, odd, strict=True) if o], add_special_tokens=False)]
        mixed, own, at = iter(np.split(ids, np.cumsum(n)[:-1])), iter(alone), []
        for o in odd:
            at.append(np.array(next(own) if o else next(mixed), np.int32))
        return np.concatenate(at), np.array([len(x) for x in at], np.int64)

    def _learn(self, found: list[bytes]) -> None:
        flat, n = self._encode(found)
        k, end = len(self.memo), self.n_ids + len(flat)
        while k + len(n) > len(self.begin):
            self.begin, self.length = (np.concatenate([a, np.zeros_like(a)]) for a in (self.begin, self.length))
        while end > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.n_ids : end] = flat
        self.begin[k : k + len(n)] = self.n_ids + np.cumsum(n) - n
        self.length[k : k + len(n)] = n
        self.n_ids = end
        self.memo.update(zip(found, range(k, k + len(n)), strict=True))

    def numbered(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of texts (bytes in a row, offsets) as numbers, one text after the other, and the cuts between texts; they hold until the next call.

        Words end at the six white-space characters of ASCII; a comma or stop after a letter and before white space is a pre-token of its own.
        Only the distinct words of the call meet the memo.
        """
        if len(self.memo) > self.MEMO:
            self._reset()
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        ink = ~kernel.SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets] = True
        first = first[:-1]
        mark = np.zeros(len(data), bool)
        at = np.flatnonzero((data[1:-1] == 0x2C) | (data[1:-1] == 0x2E)) + 1
        before = data[at - 1] | 0x20
        mark[at[(before >= 0x61) & (before <= 0x7A) & ~ink[at + 1] & ~first[at] & ~first[at + 1]]] = True
        start = ink.copy()
        start[1:] &= ~ink[:-1] | mark[1:] | first[1:]
        begins = np.flatnonzero(start)
        cuts = np.searchsorted(begins, offsets)
        if not len(begins):
            return np.zeros(0, np.int64), cuts
        # without its white space, the text is its words in a row
        solid = data[ink]
        places = np.append(np.flatnonzero(start[ink]), len(solid))
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(solid)])
        distinct = words.dictionary_encode()
        named = distinct.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.memo.get, named))
        missing = [i for i, k in enumerate(known) if k is None]
        if missing:
            self._learn([named[i] for i in missing])
            known = map(self.memo.__getitem__, named)
        numbers = np.fromiter(known, np.int64, len(named))
        return numbers[distinct.indices.to_numpy()], cuts

    def word_numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """Each text as numbers of words; they hold until the next call."""
        numbers, cuts = self.numbered(*kernel.as_bytes(pa.array(texts, pa.large_binary())))
        return np.split(numbers, cuts[1:-1])[: len(texts)]

    def ids_of(self, words: np.ndarray) -> np.ndarray:
        """The ids of a sequence of word numbers, joined."""
        n = self.length[words]
        total = int(n.sum())
        first = np.repeat(self.begin[words] - (np.cumsum(n) - n), n)
        return self.ids[first + np.arange(total)]


@functools.lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    """One for each worker process, with what it has learnt."""
    return PieceCounter(path)


@functools.lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One for each worker process, with what it has learnt."""
    return WordEncoder(path)


def give_back() -> None:
    """Returns freed memory to the system; numpy's and Arrow's allocators would keep the most that any task has taken."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def forget() -> None:
    """Frees what a worker process has learnt, before work that needs its memory and no tokenizer."""
    piece_counter.cache_clear()
    word_encoder.cache_clear()
    give_back()


def light(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work that needs no tokenizer, begun without what earlier tasks have left and leaving nothing itself."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run
