"""Token ids of whole texts by a public tokenizer, memoised by word inside each Python worker."""

from __future__ import annotations

import ctypes
import os
import re

import numpy as np
import pyarrow as pa

#: Entries kept in a worker's memory at once (some 150 MB together); a full table is emptied, results don't depend on it.
MEMO_CHUNKS, MEMO_CORES = 400_000, 1_000_000
#: Characters of texts whose words are held at once (a single text may have more).
RUN_CHARS = 1 << 19

#: Python splits at these, the vocabulary's pre-tokenizer does not.
_ODD_SPACES = "\x1c\x1d\x1e\x1f"
_BEYOND_LATIN = re.compile("[^\x00-\u024f]")
_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Encodes texts as ``tokenizers`` would (no special tokens added), one memo entry per word.

    The vocabulary drops white space before it splits, so the ids of a text are the ids of its
    white-space separated chunks in a row. A chunk of letters with a tail of , . ; : is split again,
    as the pre-tokenizer does, so that tails don't multiply the memo.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.chunks: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _raw(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn_cores(self, cores: list[str]) -> None:
        for k in range(0, len(cores), 2000):
            part = cores[k : k + 2000]
            ids = np.array(self._raw([" ".join(part)])[0], np.uint32)
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(part):
                begin = 0
                for word, end in zip(part, cut.tolist(), strict=True):
                    self.cores[word] = ids[begin:end].tobytes()
                    begin = end
            else:
                for word, one in zip(part, self._raw(part), strict=True):
                    self.cores[word] = np.array(one, np.uint32).tobytes()

    def _learn(self, chunks: set[str], latin: bool) -> None:
        if len(self.cores) > MEMO_CORES:
            self.cores.clear()
        plain, cores, odd = [], [], []
        known = self.cores
        for c in chunks:
            core = c.rstrip(",.;:")
            if core.isalpha() and (latin or core.isascii()):
                plain.append(c)
                cores.append(core)
            else:
                odd.append(c)
        tails = {c[len(core) :] for c, core in zip(plain, cores, strict=True)}.difference(known, [""])
        self._learn_cores(list(set(cores).difference(known)))
        for words, into in ((list(tails), known), (odd, self.chunks)):
            for x, one in zip(words, self._raw(words), strict=True):
                into[x] = np.array(one, np.uint32).tobytes()
        for c, core in zip(plain, cores, strict=True):
            self.chunks[c] = known[core] if len(core) == len(c) else known[core] + known[c[len(core) :]]

    def encode(self, texts: list[str | None]):
        """Little-endian unsigned 32-bit ids of each text. New words of texts of about ``RUN_CHARS`` characters together are learned at once."""
        run: list[list[str]] = []
        words_of: dict[bool, list[list[str]]] = {True: [], False: []}
        size = 0
        for text in texts:
            latin = bool(text) and (text.isascii() or not _BEYOND_LATIN.search(text)) and "<|" not in text and "İ" not in text
            if latin:
                text = text.lower()  # as the vocabulary's normaliser does
            words = (_ASCII_SPACE.split(text) if any(x in text for x in _ODD_SPACES) else text.split()) if text else []
            if size and size + len(words and text) > RUN_CHARS:
                yield from self._known(run, words_of)
                run, words_of, size = [], {True: [], False: []}, 0
            run.append(words)
            words_of[latin].append(words)
            size += len(words and text)
        yield from self._known(run, words_of)

    def _known(self, run: list[list[str]], words_of: dict[bool, list[list[str]]]):
        """The ids of each text of ``run``; ``words_of`` are the same words by whether the text is of Latin letters alone."""
        if len(self.chunks) > MEMO_CHUNKS:
            self.chunks.clear()
        for latin, lists in words_of.items():
            if missing := set().union(*lists).difference(self.chunks):
                self._learn(missing, latin)
        for words in run:
            yield b"".join(map(self.chunks.__getitem__, words))


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a vocabulary file and Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def forget() -> None:
    """Drops this worker's vocabularies and memos and gives their memory back to the system: for tasks of other operators, as workers are used again. Results don't depend on it."""
    if _loaded:
        _loaded.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):
            pass  # a system without it
