"""Byte-pair encoding by dynamic programming over prefixes.

``PrefixEncoder`` encodes one pre-token.  For every prefix it stores the one
token that ends the prefix's encoding: an automaton over the vocabulary
gives the tokens that are suffixes of the prefix (longest first), and the
first whose predecessor, the stored token of the prefix before it, is
compatible with it is the token.  Two tokens are compatible if the
concatenation of their texts encodes to exactly these two; that is decided
from the merge ranks by walking back both tokens' merge trees.  Following
the stored tokens backwards gives the ids, and counting them along the
prefixes gives the number of tokens of every prefix.

``Tokenizer`` adds the pre-tokenisation of the two public tokenizers and a
bounded cache of pre-tokens, as most pre-tokens of a corpus repeat.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import numpy as np
import regex

CACHE_ENTRIES = 200_000
#: Codes are two strings each.
CODE_ENTRIES = 100_000
COMPATIBLE_ENTRIES = 150_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


_BYTE_CHARS = byte_characters()
_LATIN = {b: c for b, c in enumerate(_BYTE_CHARS)}


def mapped(piece: str) -> str:
    """The bytes of a text as byte-level characters."""
    return piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_LATIN)


class PrefixEncoder:
    """Exact BPE of symbol strings; the last symbol may carry an end-of-word mark."""

    #: Private-use characters that stand for a symbol with the end-of-word mark.
    _END = 0xE000

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end_mark: str = ""):
        self.end_mark = end_mark
        self.text = {i: s for s, i in vocab.items()}
        split: dict[int, tuple[int, int]] = {}
        rank: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            left, right = vocab[a], vocab[b]
            rank[left, right] = r
            split[vocab[a + b]] = (left, right)
        self.rank, self.split = rank, split
        self.merge_rank = {vocab[a + b]: r for r, (a, b) in enumerate(merges)}
        self._vocab = vocab
        self._compatible: dict[int, bool] = {}
        self._tokens = ahocorasick.Automaton()
        for token, i in vocab.items():
            form = self._form(token)
            self._tokens.add_word(form, (len(form), i))
        self._tokens.make_automaton()

    def _form(self, token: str) -> str:
        mark = self.end_mark
        if mark and token.endswith(mark) and len(token) > len(mark):
            token = token[: -len(mark)]
            return token[:-1] + chr(self._END + ord(token[-1]))
        return token

    def compatible(self, left: int, right: int) -> bool:
        pair = left << 20 | right
        known = self._compatible.get(pair)
        if known is None:
            if len(self._compatible) >= COMPATIBLE_ENTRIES:
                self._compatible.clear()
            known = self._compatible[pair] = self._stands(left, right)
        return known

    def _stands(self, left: int, right: int) -> bool:
        """Whether no merge across the border comes before the merges that build the two tokens."""
        rank, split, made = self.rank, self.split, self.merge_rank
        limit = float("inf")
        a, b = left, right
        while True:
            crossing = rank.get((a, b))
            if crossing is not None and crossing < limit:
                return False
            # Undo the later of both tokens' last merges; the border then lies between earlier tokens.
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit = ra
                a = split[a][1]
            else:
                # Merges of one rank go from left to right: an equal crossing merge comes before the right token's.
                limit = rb + 1
                b = split[b][0]

    def last_tokens(self, symbols: str) -> list[int]:
        """For every prefix of 1, 2, ... symbols, the last token of its encoding."""
        last: list[int] = []
        done = 0
        known = self._compatible
        for end, (size, token) in self._tokens.iter(symbols):
            if end < done:
                continue
            start = end + 1 - size
            if start:
                fits = known.get(last[start - 1] << 20 | token)
                if fits is None:
                    fits = self.compatible(last[start - 1], token)
                if not fits:
                    continue
            last.append(token)
            done = end + 1
        return last

    def encode(self, symbols: str) -> list[int]:
        """Ids of one pre-token given as byte-level characters."""
        if not symbols:
            return []
        if self.end_mark:
            symbols = symbols[:-1] + chr(self._END + ord(symbols[-1]))
        last = self.last_tokens(symbols)
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= self._sizes[token]
        out.reverse()
        return out

    @property
    def _sizes(self) -> dict[int, int]:
        sizes = self.__dict__.get("_size_of")
        if sizes is None:
            sizes = self.__dict__["_size_of"] = {i: len(self._form(t)) for t, i in self._vocab.items()}
        return sizes

    def prefix_counts(self, symbols: str) -> list[int]:
        """Number of tokens of every prefix (encodings without an end mark)."""
        counts: list[int] = []
        sizes = self._sizes
        for i, token in enumerate(self.last_tokens(symbols)):
            before = i + 1 - sizes[token]
            counts.append(1 + (counts[before - 1] if before else 0))
        return counts


class Tokenizer:
    """One of the public JSON tokenizers, read by our own code."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        mark = model.get("end_of_word_suffix") or ""
        self.encoder = PrefixEncoder(model["vocab"], merges, mark)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = dict(self.encoder.text) | {i: t for t, i in self.special.items()}
        self.folded = spec["normalizer"] is not None
        splits = [p for p in (spec["pre_tokenizer"].get("pretokenizers") or [spec["pre_tokenizer"]]) if p["type"] == "Split"]
        #: Whether no pre-token holds a space after another character.
        self.spaced = not splits and not self.folded
        # Fixed value: the byte-level pre-token pattern of the public tokenizer.
        pattern = splits[0]["pattern"]["Regex"] if splits else r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.find = regex.compile(pattern).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in self.special) + ")").split

    def parts(self, text: str) -> list[str]:
        """The text between special strings, and at odd places the special strings."""
        if "<|" not in text:
            return [text]
        return self.cut(text)

    def fold(self, text: str) -> str:
        """The normaliser: NFC, white space to a space, lower case letter by letter."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        return self.find(self.fold(text) if self.folded else text)

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(self.parts(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                for piece in self.pieces(part):
                    out += self.encoder.encode(mapped(piece))
        return out


class PieceCache(dict):
    """Results by pre-token, computed on first use; emptied when full, so its memory is bounded."""

    def __init__(self, compute, entries: int = CACHE_ENTRIES, longest: int = 64):
        super().__init__()
        self.compute, self.entries, self.longest = compute, entries, longest

    def __missing__(self, piece: str):
        value = self.compute(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.entries:
                self.clear()
            self[piece] = value
        return value


@lru_cache(maxsize=1)
def tokenizer_of(path: str) -> Tokenizer:
    """A worker process reads a vocabulary once, whatever the number of its tasks."""
    return Tokenizer(path)


def token_count_cache(path: str) -> PieceCache:
    """Tokens of whole pre-tokens. A task's own: an idle worker holds none."""
    encoder = tokenizer_of(path).encoder
    return PieceCache(lambda piece: encoder.prefix_counts(mapped(piece))[-1])


def code_cache(path: str) -> PieceCache:
    """Ids and texts of the tokens of whole pre-tokens, each joined by a space. A task's own."""
    tokenizer = tokenizer_of(path)
    encode, text_of = tokenizer.encoder.encode, tokenizer.text_of

    def compute(piece: str) -> tuple[str, str]:
        ids = encode(mapped(piece))
        return " ".join(map(str, ids)), " ".join([text_of[i] for i in ids])

    return PieceCache(compute, CODE_ENTRIES)


class _Unclean(Exception):
    """A word between two spaces that is empty, or begins or ends with white space."""


def id_packer(path: str, item: str) -> Callable[[str], bytes]:
    """Ids of a text as numbers of the type ``item``, joined. Its caches are a task's own.

    A space between two other characters always begins a pre-token of a
    byte-level tokenizer, so the words between spaces are cached whole; only
    parts with other white space beside a space are cut by the pattern.
    """
    tokenizer = tokenizer_of(path)
    encode = tokenizer.encoder.encode
    piece = PieceCache(lambda p: np.array(encode(mapped(p)), item).tobytes()).__getitem__

    def compute(word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise _Unclean
        return b"".join(map(piece, tokenizer.find(" " + word)))

    after_space = PieceCache(compute).__getitem__

    def pack_part(part: str) -> bytes:
        if tokenizer.spaced and part:
            first, *words = part.split(" ")
            if first and not first[-1].isspace():
                try:
                    return b"".join([*map(piece, tokenizer.find(first)), *map(after_space, words)])
                except _Unclean:
                    pass
        return b"".join(map(piece, tokenizer.pieces(part)))

    def pack(text: str) -> bytes:
        return b"".join([np.array([tokenizer.special[part]], item).tobytes() if k % 2 else pack_part(part) for k, part in enumerate(tokenizer.parts(text))])

    return pack
