"""Encoding with the tokenizers library, each distinct piece of text once per worker.

A byte-level tokenizer splits its input before every single space between two other characters, and one that drops white
space splits at every space; both split between a letter or digit and a full stop or another mark that ends a word. What lies
between is encoded on its own. So a text's ids are the ids of its pieces in order, and pieces recur. Arrow takes texts apart
and numbers the pieces, so Python meets the distinct ones alone. Texts with any other white space go to a byte-level tokenizer
whole, as do texts that hold a special token, and all texts to a tokenizer of another kind.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

from tokenizers import Tokenizer  # noqa: E402
from tokenizers.pre_tokenizers import ByteLevel  # noqa: E402

_ODD_SPACE = re.compile(r"[^\S \n]")
_ODD = ("  ", "\n ", " \n", "\n\n\n", "\t", "\r", "\v", "\f", "\x1c", "\x1d", "\x1e", "\x1f", "\0")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_WORD_END = f"([{_LETTERS}0-9])([!-&(-/:-@\\[-`{{-~]+)([ \\n]|$)"  # no apostrophe, which may belong to what follows
_LATIN_1 = re.compile(r"[\0-\xff]*")
_PLAIN = re.compile(f" ?[{_LETTERS}]+")


class Ragged:
    """Rows of ids of different lengths, one behind the other."""

    def __init__(self):
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.rows = np.zeros(1 << 14, np.int64), 0

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.rows + len(sizes) >= len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.start[self.rows + 1 : self.rows + 1 + len(sizes)] = self.used + np.cumsum(sizes)
        self.used, self.rows = self.used + len(ids), self.rows + len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of ``rows`` in order, and how many each has."""
        start = self.start[rows]
        size = self.start[rows + 1] - start
        return self.ids[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())], size


class PieceEncoder:
    """``encode_flat(texts)`` gives all ids behind one another; ``encode(texts)`` each text's ids as little-endian bytes.

    The pieces met and their ids are kept; a table of more than ``limit`` is forgotten and gathered anew.
    """

    def __init__(self, path: str, limit: int = 400_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = tokenizer_kind(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.bare = Tokenizer.from_file(path)  # for pieces that normalising and splitting would leave alone
        self.bare.normalizer = self.bare.pre_tokenizer = None
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.written = {ord(c): as_bytes(c)[0][0] for c in map(chr, range(32, 256)) if not c.isascii() or c == " "}
        self.letters = {c: w for c, w in self.written.items() if c != 32}
        self.limit = limit
        self._forget()

    def _forget(self) -> None:
        self.known, self.table = {}, Ragged()

    def _append(self, texts: list[str]) -> None:
        coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.table.append(np.fromiter(chain.from_iterable(coded), np.uint32), np.array([len(c) for c in coded], np.int64))

    def _append_words(self, words: list[str]) -> None:
        """Pieces of letters skip all steps but the merges, many to a call."""
        text = "\n".join(words) if self.kind == "byte" else "\n".join(words).lower()
        text = text.replace(" ", self.written[32])
        if not all(map(str.isascii, words)):
            text = "\n".join([w if w.lstrip(self.written[32]).isascii() else w.translate(self.letters) for w in text.split("\n")])
        words = text.split("\n") if words else []
        for a in range(0, len(words), 500):
            some = words[a : a + 500]
            coded = self.bare.encode(some, is_pretokenized=True, add_special_tokens=False)
            self.table.append(np.array(coded.ids, np.uint32), np.bincount(coded.word_ids, minlength=len(some)))

    def _rows(self, pieces: list[str]) -> np.ndarray:
        """The table's row of each of ``pieces``, which are distinct."""
        known = self.known
        new = [p for p in pieces if p not in known]
        plain, other = [], []
        for p in new:
            (plain if p.isalpha() and p.isascii() or _PLAIN.fullmatch(p) else other).append(p)
        known.update(zip(chain(plain, other), range(self.table.rows, self.table.rows + len(new)), strict=True))
        self._append_words(plain)
        self._append(other)
        return np.fromiter(map(known.__getitem__, pieces), np.int64, len(pieces))

    def _whole(self, text: str) -> bool:
        if self.kind == "whole" or any(s in text for s in self.special) or "\0" in text:
            return True
        return self.kind == "byte" and (any(s in text for s in _ODD) or text.endswith("\n\n") or not text.isascii() and bool(_ODD_SPACE.search(text)))

    def encode_flat(self, texts: list[str], end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, unsigned 32-bit, and the ``len(texts) + 1`` offsets; ``end_id`` follows each text."""
        if len(self.known) > self.limit:
            self._forget()
        whole = np.array([self._whole(t) for t in texts], bool)
        plain = pa.array([(t.lower() if self.kind == "word" and _LATIN_1.fullmatch(t) else t) for t, w in zip(texts, whole, strict=True) if not w], pa.string())
        parts = pc.replace_substring_regex(plain, _WORD_END, "\\1\0\\2\\3")
        if self.kind == "byte":
            parts = pc.replace_substring(pc.replace_substring(parts, "\n", "\0\n\0"), " ", "\0 ")
        else:
            parts = pc.replace_substring(pc.replace_substring(parts, "\n", "\0"), " ", "\0")
        split = pc.split_pattern(parts, "\0")
        coded = split.values.dictionary_encode()
        rows = self._rows(coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.int64)
        count = np.ones(len(texts), np.int64)
        count[~whole] = np.diff(split.offsets.to_numpy())
        base, used = self.table.rows, self.table.used
        self._append([t for t, w in zip(texts, whole, strict=True) if w])  # these rows are for this call only
        if end_id is not None:
            self.table.append(np.array([end_id], np.uint32), np.array([1]))
            count += 1
        ends = np.cumsum(count)
        kind = np.zeros(ends[-1] if len(ends) else 0, np.int8)
        if end_id is not None:
            kind[ends - 1] = 2
        kind[(ends - count)[whole]] = 1
        at = np.empty(len(kind), np.int64)
        at[kind == 0], at[kind == 1], at[kind == 2] = rows, base + np.arange(whole.sum()), self.table.rows - 1
        ids, size = self.table.take(at)
        self.table.rows, self.table.used = base, used
        return ids, np.r_[0, np.cumsum(size)][np.r_[0, ends]]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, offsets = self.encode_flat(texts)
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    """One encoder per worker process, so that tasks share what it remembers."""
    return PieceEncoder(path)


def tokenizer_kind(path: str) -> str:
    """``byte``, ``word``, or ``whole`` where pieces can't be encoded on their own."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if before.get("type") == "ByteLevel" and norm is None and not before.get("add_prefix_space") and before.get("use_regex", True):
        return "byte"
    steps = before.get("pretokenizers") or [{}]
    drops = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"\s" in str(steps[0].get("pattern"))
    if before.get("type") == "Sequence" and drops and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space"):
        return "word"
    return "whole"


def in_chunks(texts: list[str], most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` of about ``most`` characters each; one longer text is a range of its own."""
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > most:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)
