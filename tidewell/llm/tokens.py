"""Tokenising whole texts with a public tokenizer file, inside tasks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The tokenizer of the queries, and the id that ends each document.
TOKENIZER, END = "byte_bpe_50k.json", 0
#: Words that a worker remembers at most, and those that it keeps when it has as many.
CACHE, KEPT = 300_000, 100_000
#: Characters of text, and new words, that are encoded together.
TOGETHER, TOGETHER_WORDS = 1 << 21, 50_000

_TEARS = re.compile(r" (?=\S)")
#: First character beyond those that every table of letters agrees on.
_LATIN = "\u0250"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else one from 256 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


_LETTERS = dict(enumerate(byte_letters()))
_SPACE = _LETTERS[0x20]
_open: dict[str, Encoder] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A byte-level tokenizer with the usual word pattern never makes a token across the
    place before a space that stands before a non-space; so texts are torn there and each
    distinct word is encoded once.  Texts that hold an added token, such as a mark of a
    text's end, and other tokenizers get whole texts.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self._forget()
        if self.byte_level:
            vocab = self.tokenizer.get_vocab()
            #: the same vocabulary for words that are parted already
            self.bare = Tokenizer(self.tokenizer.model)
            self.marks = {c: vocab[c] for c in ".,;:!?" if c in vocab}
            self.begins = np.zeros(max(vocab.values()) + 1, bool)
            self.begins[[i for token, i in vocab.items() if token.startswith(_SPACE)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.byte_level or not texts:
            return self._ids(texts)
        column = pa.array(texts, pa.large_string())
        whole = np.zeros(len(texts), bool)
        for token in self.added:
            whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
        out = self._plain(column)
        for i in np.flatnonzero(whole).tolist():
            out[i] = self._ids(texts[i : i + 1])[0]
        for i in [i for i, ids in enumerate(out) if ids is None]:
            head, *rest = _TEARS.split(texts[i])
            out[i] = b"".join(self._ids([head, *map(" ".__add__, rest)]))
        return out

    def _forget(self) -> None:
        """No words are known: their rows, and by row the ids, where they end and in how many calls the word came."""
        self.rows: dict[str, int] = {}
        self.flat, self.ends, self.calls = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _keep(self, n: int) -> None:
        """Forget all words but the ``n`` that came in most calls."""
        best = np.sort(np.argsort(-self.calls, kind="stable")[:n])
        words, size = list(self.rows), np.diff(self.ends)
        taken = np.zeros(len(size), bool)
        taken[best] = True
        self.rows = {words[i]: k for k, i in enumerate(best.tolist())}
        self.flat, self.ends, self.calls = self.flat[np.repeat(taken, size)], np.concatenate([[0], np.cumsum(size[best])]), self.calls[best] // 2

    def _learn(self, words: list[str], letters: bool) -> None:
        """Rows for new words, whose ids with a space begin anew.  Words of letters are one piece each, so they
        need no parting; others go in as one text."""
        sizes, parts = [], [self.flat]
        for lo in range(0, len(words), TOGETHER_WORDS):
            some = words[lo : lo + TOGETHER_WORDS]
            if letters:
                spelt = [_SPACE + (w if w.isascii() else w.encode().decode("latin-1").translate(_LETTERS)) for w in some]
                got = self.bare.encode_batch_fast([spelt], is_pretokenized=True, add_special_tokens=False)
            else:
                got = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(got[0].ids, "<u4")
            cut = np.flatnonzero(self.begins[ids])
            if len(cut) != len(some):
                raise ValueError("a token with a space inside")
            sizes.append(np.diff(np.append(cut, len(ids))))
            parts.append(ids)
        if words:
            self._add(words, np.concatenate(parts), np.concatenate(sizes))

    def _add(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> None:
        n = len(self.rows)
        self.flat = flat
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(size)])
        self.calls = np.concatenate([self.calls, np.zeros(len(words), np.int32)])
        self.rows.update(zip(words, range(n, n + len(words)), strict=True))

    def _row_of(self, words: list[str]) -> np.ndarray:
        """Row of each distinct word: its ids after a space.  Words hold no spaces and begin with no white space."""
        found = list(map(self.rows.get, words))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            plain: dict[str, None] = {}
            marked, others = [], []
            for i in missing:
                w = words[i]
                if w.isalpha() and (w.isascii() or max(w) < _LATIN):
                    plain[w] = None
                elif w[-1] in self.marks and (x := w[:-1]).isalpha() and (x.isascii() or max(x) < _LATIN):
                    marked.append(w)
                    if x not in self.rows:
                        plain[x] = None
                else:
                    others.append(w)
            self._learn(list(plain), True)
            self._learn(others, False)
            if marked:  # a word of letters and the piece of one mark
                at = np.array([self.rows[w[:-1]] for w in marked])
                size = np.diff(self.ends)[at]
                ends = np.cumsum(size + 1)
                flat = np.empty(ends[-1], "<u4")
                flat[ends - 1] = [self.marks[w[-1]] for w in marked]
                first = ends - size - 1
                step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                flat[np.repeat(first, size) + step] = self.flat[np.repeat(self.ends[at], size) + step]
                self._add(marked, np.concatenate([self.flat, flat]), size + 1)
            for i in missing:
                found[i] = self.rows[words[i]]
        rows = np.array(found, np.int64)
        self.calls[rows] += 1
        return rows

    def _plain(self, column: pa.Array) -> list[bytes | None]:
        """Ids of texts whose units are what single spaces part, None for others.

        Words are numbered, and the ids of the numbers gathered.
        """
        if len(self.rows) > CACHE:
            self._keep(KEPT)
        units = pc.split_pattern(column, " ")
        off = units.offsets.to_numpy()
        coded = units.flatten().dictionary_encode()
        at = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        # a space before white space or the end is not torn off: such texts are left to the caller
        first = pc.utf8_slice_codeunits(coded.dictionary, 0, 1)
        odd = pc.or_(pc.equal(first, ""), pc.utf8_is_space(first)).to_numpy(zero_copy_only=False)
        bad = odd[at]
        bad[off[:-1]] = False
        bad = np.logical_or.reduceat(bad, off[:-1])
        # a text's first unit has no space before it
        firsts = self._ids(words[at[off[:-1]]].tolist())
        row = np.zeros(len(words), np.int64)
        row[~odd] = self._row_of(words[~odd].tolist())
        known = len(self.ends) - 1
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(firsts), "<u4")])
        size = np.concatenate([np.diff(self.ends), np.array(list(map(len, firsts)), np.int64) >> 2])
        begin = np.cumsum(size) - size
        at = row[at]
        at[off[:-1]] = known + np.arange(len(firsts))
        n = size[at]
        end = np.cumsum(n)
        ids = flat[np.repeat(begin[at] - (end - n), n) + np.arange(end[-1])]
        cut = np.concatenate([[0], end])[off]
        return [None if o else ids[a:b].tobytes() for a, b, o in zip(cut[:-1].tolist(), cut[1:].tolist(), bad.tolist(), strict=True)]

    def byte_lengths(self) -> np.ndarray:
        """Bytes of each id of a byte-level vocabulary, whose letters stand for bytes."""
        vocab = self.tokenizer.get_vocab()
        out = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            out[i] = len(token)
        return out


def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a tokenizer file; each worker opens a file once."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _open:
        _open[path] = Encoder(path)
    return _open[path]


def torn(text: str, limit: int) -> list[str]:
    """``text`` in parts of about ``limit`` characters, torn before a space that stands before a non-space."""
    out, lo = [], 0
    while len(text) - lo > limit:
        tear = _TEARS.search(text, lo + limit)
        if not tear:
            break
        out.append(text[lo : tear.start()])
        lo = tear.start()
    return [*out, text[lo:]]


def encoded(texts: list[str | None], path: str | None = None, limit: int = TOGETHER) -> Iterator[bytes]:
    """Ids of each text (null: empty), some megabytes of text at a time; longer texts go in parts."""
    enc = encoder(path)
    held: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > limit:
            yield from enc.encode(held)
            held, size = [], 0
        if len(text) > limit and enc.byte_level and not any(t in text for t in enc.added):
            yield b"".join([enc.encode([part])[0] for part in torn(text, limit)])
            continue
        held.append(text)
        size += len(text)
    if held:
        yield from enc.encode(held)
