"""Encoding with a public vocabulary, one distinct pre-token at a time.

A BPE vocabulary never merges across pre-tokens, so a text's ids are its pre-tokens' ids in a row. Texts are
cut at spaces first (neither vocabulary here has a pre-token that holds a space after its first character, but
for runs of blanks, which are found and left to the library), and each distinct cut piece is worked out once
per worker. The merges themselves are always done by the ``tokenizers`` library.
"""

from __future__ import annotations

import re
import struct

from tokenizers import Tokenizer

#: Entries that a worker keeps before it starts anew; bounds its memory, changes no result.
CACHE_ENTRIES = 1_500_000
#: Letters of a pre-token that is so short that it is kept by itself: punctuation, most of all.
SHORT = 4

_BLANKS = re.compile(r"\s (?:\s|\Z)")


def _byte_letters() -> dict[int, str]:
    """Byte to letter, as byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


BYTE_LETTERS = _byte_letters()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _letters(s: str) -> str:
    return s if s.isascii() else s.encode().decode("latin-1").translate(BYTE_LETTERS)


def _all_letters(s: str) -> str:
    """As _letters, for strings that may hold blanks and controls."""
    return s.encode().decode("latin-1").translate(BYTE_LETTERS)


def _usual(word: str) -> bool:
    """Of code points whose class, case and normal form no Unicode version has changed."""
    return word.isascii() or max(word) < "İ"


class _Known(dict):
    """What pieces have been worked out; works out the others as they are asked for."""

    def __init__(self, work):
        self.work = work

    def __missing__(self, piece: str) -> bytes:
        self[piece] = got = self.work(piece)
        return got


class _Encoder:
    """ids(piece) with a bounded memory; a piece is a run without spaces, as the subclass cuts texts."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        # each piece is asked for once here: the library's own memory would only cost
        self.model._resize_cache(0)
        self.known = _Known(self._ids)
        self.short: dict[str, list[int]] = {}

    def _pieces(self, text: str) -> list[str]:
        raise NotImplementedError

    def _ids(self, piece: str) -> bytes:
        raise NotImplementedError

    def whole(self, text: str) -> bytes:
        return _packed(self.tok.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.known) > CACHE_ENTRIES:
            self.known.clear()
        return b"".join(map(self.known.__getitem__, self._pieces(text)))

    def _tokens(self, letters: str) -> list[int]:
        if len(letters) > SHORT:
            return [t.id for t in self.model.tokenize(letters)]
        got = self.short.get(letters)
        if got is None:
            if len(self.short) > CACHE_ENTRIES // 20:
                self.short.clear()
            self.short[letters] = got = [t.id for t in self.model.tokenize(letters)]
        return got


class WordEncoder(_Encoder):
    """For the lower-casing vocabulary with word ends, which drops all white space."""

    pattern = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+|_+")

    def _pieces(self, text: str) -> list[str]:
        return text.split()

    def encode(self, text: str) -> bytes:
        # str.split() also cuts at four control characters that are no white space to the library
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self.whole(text)
        return super().encode(text)

    def pretokens(self, word: str) -> tuple[str, ...] | None:
        """The pre-tokens of a word without white space, in byte letters; None where a special string is in it."""
        if word.isalpha() and _usual(word):
            return (_letters(word.lower()),)
        if any(s in word for s in self.special):
            return None
        if word[:-1].isalpha() and word[-1] in ".," and _usual(word):
            return _letters(word[:-1].lower()), word[-1]
        normal = self.tok.normalizer.normalize_str(word)
        return tuple(p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(normal))

    def _ids(self, piece: str) -> bytes:
        pre = self.pretokens(piece)
        if pre is None:
            return self.whole(piece)
        return _packed([i for p in pre for i in self._tokens(p)])

    def count(self, pretoken: str) -> int:
        return len(self.model.tokenize(pretoken))


class ByteEncoder(_Encoder):
    """For the byte-level vocabulary that keeps white space: a piece is a space and what follows it."""

    def _pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if _BLANKS.search(text):
            return self._by_library(text)
        if "\0" in text:
            return self._by_library(text)
        pieces = text.replace(" ", "\0 ").split("\0")
        return pieces if pieces[0] else pieces[1:]

    def _by_library(self, text: str) -> list[str]:
        """Runs of blanks make pre-tokens of their own; the library tells where they end."""
        out, at = [], 0
        special = re.split("(" + "|".join(map(re.escape, self.special)) + ")", text) if self.special else [text]
        for part in special:
            if part in self.special:
                out.append(part)
            elif part:
                spans = [e for _, (_, e) in self.tok.pre_tokenizer.pre_tokenize_str(part)]
                at = 0
                for end in spans:
                    out.append(part[at:end])
                    at = end
        return out

    #: The vocabulary's pre-tokens, for usual code points only: there, a word character is a letter, a digit or _.
    pattern = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    #: Numbers that are no digits, and controls that count as blanks here but not there.
    _odd = re.compile("[\u00b2\u00b3\u00b9\u00bc-\u00be\x1c-\x1f]")

    def _ids(self, piece: str) -> bytes:
        word = piece[1:] if piece[0] == " " else piece
        if word.isalpha() and _usual(word):
            return _packed(self._tokens(("Ġ" if piece[0] == " " else "") + _letters(word)))
        if word[:-1].isalpha() and word[-1] in ".," and _usual(word):
            return _packed(self._tokens(("Ġ" if piece[0] == " " else "") + _letters(word[:-1])) + self._tokens(word[-1]))
        if not _usual(piece) or self._odd.search(piece) or any(s in piece for s in self.special):
            return self.whole(piece)
        return _packed([i for p in self.pattern.findall(piece) for i in self._tokens(_all_letters(p))])


_kept: dict[tuple[type, str], _Encoder] = {}


def encoder(kind: type, path: str) -> _Encoder:
    """One per worker process: what it has worked out serves its later tasks too."""
    if (kind, path) not in _kept:
        _kept[kind, path] = kind(path)
    return _kept[kind, path]
