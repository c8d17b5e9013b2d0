"""Ids of public tokenizers by merge replay over the distinct words of a block (see :mod:`.merges`).

A worker keeps the ids of the words seen last, within a bound; the table is emptied when it is full,
which changes speed only. Vocabulary files are parameters; each worker reads them once.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import regex

from .merges import Merges, cut

#: Words whose ids a worker keeps at most.
HELD = 300_000
#: Pieces of words whose ids a worker keeps at most: they cost more to find anew.
HELD_PIECES = 400_000


class RankVocabulary:
    """Byte-level merges by the rank of the merged bytes; ``pattern`` splits the text before."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.first = np.array([ranks[bytes([i])] for i in range(256)])
        pairs = {}
        for piece, rank in ranks.items():
            for cut in range(1, len(piece)):
                a, b = ranks.get(piece[:cut]), ranks.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank, rank)
        self.ranks, self.merges, self.split = ranks, Merges(pairs), regex.compile(pattern).findall
        self.seen: dict[str, bytes] = {}
        self.adjacent = re.compile(r"\s\s").search

    def _learn(self, pieces: list[str]) -> None:
        """The ids of new pieces."""
        raw = [p.encode() for p in pieces]
        symbols = self.first[np.frombuffer(b"".join(raw), np.uint8)]
        self.seen.update(zip(pieces, cut(*self.merges.replay(symbols, np.fromiter(map(len, raw), np.int64, len(raw)))), strict=True))

    def chunks(self, text: str) -> list[str]:
        """Parts that the pattern never matches across: cuts before single spaces.

        Where two white-space characters stand together, the text is one part.
        """
        if " " not in text or self.adjacent(text):
            return [text]
        parts = text.split(" ")
        parts[1:] = [" " + p for p in parts[1:]]
        return parts if parts[0] else parts[1:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers, by the pattern and the ranks, without special tokens."""
        if len(self.seen) > HELD:
            self.seen = {}
        seen = self.seen
        split = [self.chunks(t) if t else [] for t in texts]
        new: set[str] = set()
        for parts in split:
            new.update(parts)
        new = {p for p in new if p not in seen}
        pieces = dict(zip(new, map(self.split, new), strict=True))
        self._learn(list({p for found in pieces.values() for p in found if p not in seen}))
        for part, found in pieces.items():
            if len(found) != 1:
                seen[part] = b"".join([seen[p] for p in found])
        out = [b"".join(map(seen.__getitem__, parts)) for parts in split]
        for part in pieces:
            if len(part) > 64:  # whole texts aren't kept
                seen.pop(part, None)
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class WordVocabulary:
    """Merges with word ends of a ``tokenizers`` file; lower case, white space dropped.

    Words of ASCII letters and punctuation, and of letters that lower-case one to one, are done by merge
    replay; all others by the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            pairs[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.merges, self.library = Merges(pairs), Tokenizer.from_file(path)
        names = byte_names()
        self.inner = np.array([vocab[names[b]] for b in range(256)])
        self.final = np.array([vocab[names[b] + model["end_of_word_suffix"]] for b in range(256)])
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # ASCII that is no control, and composed letters whose lower case is one character
        safe = {chr(i) for i in range(0x21, 0x7F)} | {chr(i) for i in range(0xC0, 0x17F) if plain(chr(i))}
        self.plain = re.compile("[" + re.escape("".join(sorted(safe))) + "]*").fullmatch
        self.seen: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _parts(self, word: str) -> list[str] | None:
        """The pieces of a word, or None if the library must tell."""
        if not self.plain(word) or "<|" in word:
            return None
        if word.isalpha():
            return [word.lower()]
        if word[-1] in ".," and word[:-1].isalpha():
            return [word[:-1].lower(), word[-1]]
        return self.split(word.lower())

    def _learn(self, words: set[str]) -> None:
        pieces, single, marked, simple = self.pieces, {}, [], {}
        for word in words:  # most are ASCII letters, or these and a full stop or comma
            if word.isascii():
                if word.isalpha():
                    single[word] = word.lower()
                    continue
                if word[-1] in ".," and word[:-1].isalpha():
                    marked.append(word)
                    continue
            simple[word] = self._parts(word)
        needed = {*single.values(), *(w[:-1].lower() for w in marked), *(w[-1] for w in marked)}
        for found in simple.values():
            needed.update(found or ())
        new = [p for p in needed if p not in pieces]
        raw = [p.encode() for p in new]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols, last = self.inner[flat], np.cumsum(sizes) - 1
        symbols[last] = self.final[flat[last]]
        pieces.update(zip(new, cut(*self.merges.replay(symbols, sizes)), strict=True))
        self.seen.update(zip(single, map(pieces.__getitem__, single.values()), strict=True))
        for word in marked:
            self.seen[word] = pieces[word[:-1].lower()] + pieces[word[-1]]
        rest = []
        for word, found in simple.items():
            if found is None:
                rest.append(word)
            else:
                self.seen[word] = pieces[found[0]] if len(found) == 1 else b"".join([pieces[p] for p in found])
        for at in range(0, len(rest), 1000):
            part = rest[at : at + 1000]
            for word, found in zip(part, self.library.encode_batch_fast(part, add_special_tokens=False), strict=True):
                self.seen[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers."""
        if len(self.seen) > HELD:
            self.seen = {}
        if len(self.pieces) > HELD_PIECES:
            self.pieces = {}
        split = [ascii_words(t) for t in texts]
        new: set[str] = set()
        for words in split:
            new.update(words)
        self._learn({w for w in new if w not in self.seen})
        out = [b"".join(map(self.seen.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > 64:
                self.seen.pop(word, None)
        return out


_ODD_SPACES = re.compile("[\x1c-\x1f\x85\xa0  -     　]").search
_ASCII_WORDS = re.compile("[^\x20\x09-\x0d]+").findall


def ascii_words(text: str) -> list[str]:
    """Runs of anything but ASCII white space. (The fast way also cuts at other white space, if there is any.)"""
    return _ASCII_WORDS(text) if _ODD_SPACES(text) else text.split()


def plain(c: str) -> bool:
    low = c.lower()
    return len(low) == 1 and regex.fullmatch(r"\p{L}", c) is not None and regex.fullmatch(r"\p{L}", low) is not None and unicodedata.normalize("NFC", c) == c


def byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: printable Latin-1
    bytes stand for themselves, the others follow from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=2)
def rank_vocabulary(path: str, pattern: str) -> RankVocabulary:
    return RankVocabulary(path, pattern)


@lru_cache(maxsize=2)
def word_vocabulary(path: str) -> WordVocabulary:
    return WordVocabulary(path)
