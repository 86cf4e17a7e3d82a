"""Token ids by the public tokenizers, with a memory of pieces of text already encoded.

Byte-pair merges never cross pre-tokens, so the ids of a text are those of its
pieces in turn. Pieces recur: about a megabyte of text at once is cut into words
(with the white space before them, where that counts), equal words are found by
sorting their bytes as integers, and each different one is looked up once in
arrays. The tokenizer is asked only for those that the memory doesn't hold.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from wavefix.llm.common import CHUNK, word_spans

#: Entries of the memories of words (about 55 bytes each) and of pieces (about 150); once full, new ones are encoded each time.
WORDS, PIECES = 1_000_000, 50_000
#: Bytes of the longest word or piece that is compared and remembered; longer ones are encoded each time.
LONGEST = 24

#: The vocabularies' own patterns (as their files and library describe them).
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: White space on which Python and the tokenizers may differ: such texts go to the tokenizer whole.
_ODD = re.compile("[" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\n\r\f\v") + "]")


class _Memory(dict):
    def __init__(self, make: Callable[[str | bytes], bytes], most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str | bytes) -> bytes:
        out = self.make(key)
        if len(self) < self.most and len(key) <= LONGEST:
            self[key] = out
        return out


class PieceEncoder:
    """``ids(text)`` and ``all_ids(texts)``: the ids of whole texts as little-endian 32-bit integers."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        normalizer, model = self.tokenizer.normalizer, self.tokenizer.model
        self.normal = normalizer.normalize_str if normalizer is not None else None
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        split = regex.compile(WORD_SPLIT if self.normal else BYTE_SPLIT)
        table = _byte_marks()
        if set(table) != set(ByteLevel.alphabet()):
            raise ValueError("the byte alphabet is not the expected one")
        as_latin = {i: c for i, c in enumerate(table)}
        blank = table[0x20]

        def tokens(piece: str) -> bytes:
            if piece.isalpha() and piece.isascii():
                seen = piece  # letters stand for themselves
            elif piece[0] == " " and piece[1:].isalpha() and piece.isascii():
                seen = blank + piece[1:]
            else:
                seen = piece.encode("utf-8").decode("latin-1").translate(as_latin)
            return array("I", [t.id for t in model.tokenize(seen)]).tobytes()

        pieces = _Memory(tokens, PIECES)
        words_only = self.normal is not None

        def encode(key: bytes) -> bytes:
            word = key.decode("utf-8")
            # Letters alone, after at most one blank where blanks count, are one piece.
            if words_only:
                # Below U+0250 composing changes nothing and each letter has the one lower case.
                word = word.lower() if word.isascii() or max(word) < "\u0250" else self.normal(word)
                if word.isascii() and word.isalpha():
                    return tokens(word)
            elif word.isascii() and (word[1:] if word[0] == " " else word).isalpha():
                return tokens(word)
            return b"".join(map(pieces.__getitem__, split.findall(word)))

        self.encode, self.words = encode, _Words(encode)

    def ids(self, text: str) -> np.ndarray:
        return next(self.all_ids([text]))

    def all_ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text in turn."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= CHUNK:
                yield from self._together(held)
                held, size = [], 0
        if held:
            yield from self._together(held)

    def _together(self, texts: list[str]) -> Iterator[np.ndarray]:
        whole = {i for i, text in enumerate(texts) if _ODD.search(text) or any(s in text for s in self.specials)}
        parts = [b"" if i in whole else text.encode("utf-8") for i, text in enumerate(texts)]
        sizes = np.array([len(x) for x in parts], np.int64)
        first = np.cumsum(sizes + 1) - sizes - 1
        data = np.frombuffer(b"\n".join(parts) + bytes(LONGEST), np.uint8)
        if self.normal is not None:
            # Letters before a letter's mark keep their case: composing comes first.
            data = np.where(_UPPER[data] & (np.append(data[1:], 0) < 0x80), data | 0x20, data)
        starts, ends = _cut(data, first, first + sizes, blanks=self.normal is None)
        some, which = _different(*_keys(data, starts, ends))
        flat, count = self.words.ids(data, starts[some], ends[some])
        out, upto = _gathered(flat, (np.cumsum(count) - count)[which], count[which])
        cut = upto[np.append(np.searchsorted(starts, first), len(starts))]
        for i, text in enumerate(texts):
            yield np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4") if i in whole else out[cut[i] : cut[i + 1]]


class _Words:
    """The ids of words seen before: arrays in the order of the words' hashes, and a dict of the newest."""

    def __init__(self, make: Callable[[bytes], bytes]):
        self.new = _Memory(make, 1 << 14)
        self.h, self.keys = np.empty(0, np.uint64), [np.empty(0, np.uint8), *(np.empty(0, np.uint64) for _ in range(0, LONGEST, 8))]
        self.begin, self.count, self.flat = np.empty(0, np.uint32), np.empty(0, np.uint8), np.empty(0, "<u4")

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the given words, one word after the other, and how many each has."""
        h, keys = _keys(data, starts, ends)
        at = np.minimum(np.searchsorted(self.h, h), max(len(self.h) - 1, 0))
        known = np.zeros(len(h), bool)
        if len(self.h):
            known = self.h[at] == h
            for mine, key in zip(self.keys, keys, strict=True):
                known &= mine[at] == key
        have, lack = at[known], np.flatnonzero(~known)
        whole = data.tobytes()
        made = [self.new[whole[a:b]] for a, b in zip(starts[lack].tolist(), ends[lack].tolist(), strict=True)]
        count = np.zeros(len(h), np.int64)
        count[known] = self.count[have]
        count[lack] = [len(x) >> 2 for x in made]
        begin = np.cumsum(count) - count
        flat = np.empty(int(count.sum()), "<u4")
        flat[np.repeat(known, count)] = _gathered(self.flat, self.begin[have].astype(np.int64), count[known])[0]
        flat[np.repeat(~known, count)] = np.frombuffer(b"".join(made), "<u4")
        if len(self.new) >= self.new.most and len(self.h) < WORDS:
            self._settle()
        return flat, count

    def _settle(self) -> None:
        """Move the newest words to the arrays."""
        words, ids = list(self.new), list(self.new.values())
        size = np.array([len(x) for x in words], np.int64)
        ends = np.cumsum(size)
        h, keys = _keys(np.frombuffer(b"".join(words) + bytes(LONGEST), np.uint8), ends - size, ends)
        count = np.array([len(x) >> 2 for x in ids], np.int64)
        begin = len(self.flat) + np.cumsum(count) - count
        order = np.argsort(h)
        at = np.searchsorted(self.h, h[order])
        self.h = np.insert(self.h, at, h[order])
        self.keys = [np.insert(mine, at, key[order].astype(mine.dtype)) for mine, key in zip(self.keys, keys, strict=True)]
        self.begin, self.count = np.insert(self.begin, at, begin[order]), np.insert(self.count, at, count[order])
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), "<u4")))
        self.new.clear()
        self.new.most = max(1 << 14, len(self.h) // 8)


def _gathered(flat: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``flat`` that begin there, one after the other, and where each begins (and the last ends) among them."""
    upto = np.concatenate(([0], np.cumsum(count)))
    return flat[np.repeat(begin - upto[:-1], count) + np.arange(upto[-1])], upto


_ASCII = np.array([chr(i) if i < 0x80 else "" for i in range(256)])
_UPPER = np.char.isupper(_ASCII)
_LETTER = np.char.isalpha(_ASCII)
_MARK = np.array([0x20 < i < 0x7F and not chr(i).isalnum() for i in range(256)])


def _cut(data: np.ndarray, first: np.ndarray, last: np.ndarray, blanks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts (at first to last in data), cut also where an ASCII mark follows an ASCII letter.

    No piece of either pattern goes on there. With ``blanks`` white space goes to the word after it, or is one by itself at a text's end.
    """
    data = data[: last[-1]]
    starts, ends = word_spans(data)
    inside = np.flatnonzero(_LETTER[data[:-1]] & _MARK[data[1:]]) + 1
    starts, ends = np.sort(np.concatenate((starts, inside))), np.sort(np.concatenate((ends, inside)))
    if blanks:
        if len(starts):
            starts = np.maximum(np.concatenate(([0], ends[:-1])), first[np.searchsorted(first, starts, "right") - 1])
        done = np.maximum(np.concatenate(([0], ends))[np.searchsorted(ends, last, "right")], first)
        rest = done < last
        if rest.any():
            starts, ends = np.sort(np.concatenate((starts, done[rest]))), np.sort(np.concatenate((ends, last[rest])))
    return starts, ends


_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_ODDS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA24BAED4963EE407, 0x5851F42D4C957F2D], np.uint64)


def _keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """For each word a hash, and what tells it apart: its length and bytes as integers; those of over LONGEST bytes have LONGEST + 1 as length. data has LONGEST bytes more than the words."""
    size = ends - starts
    at = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    keys = [np.minimum(size, LONGEST + 1).astype(np.uint64)]
    keys += [at[starts + i] & _MASKS[np.clip(size - i, 0, 8)] for i in range(0, LONGEST, 8)]
    return sum(k * c for k, c in zip(keys, _ODDS, strict=True)), keys


def _different(h: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, in the order of their hashes, that stand for all; and for each word the place of its own among them. Bytes decide, hashes only order; too long words stand for themselves."""
    order = np.argsort(h)
    new = keys[0][order] > LONGEST
    new[:1] = True
    for k in (h, *keys):
        k = k[order]
        new[1:] |= k[1:] != k[:-1]
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


def _byte_marks() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This process's encoder for a vocabulary file; Python workers keep it between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
