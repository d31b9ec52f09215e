"""Exact ids of public tokenizers, with one library call for each distinct word of a task.

The vocabulary files split a text into words before any merge, so the ids of a text are the ids of its words.
Words are found with a compiled expression where a text has Latin letters only; any other text goes through the
library's own normalizer and splitter.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Below this code point, normalization form C changes nothing and letter case maps within the same range.
_LATIN = 0x180
_WHITE = "\t\n\x0b\x0c\r \x85\xa0"
_LATE = re.compile(f"[^\x00-{chr(_LATIN - 1)}]")


def _of_kind(first: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LATIN) if unicodedata.category(chr(c))[0] == first)


_L, _N, _S = _of_kind("L"), _of_kind("N"), re.escape(_WHITE)
_RUN = re.compile(f"[{_S}]+")
#: The contractions that both vocabularies split off.
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
_LOWER_WORDS = re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[{_S}]|[^{_S}{_L}{_N}]+")
_BYTE_WORDS = re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
#: White space of which str.split() has its own idea, and spaces beside other white space.
_CONTROL = re.compile("[\x1c-\x1f]")
_RARE_WHITE = _WHITE.replace(" ", "").replace("\n", "")
_UNEVEN = re.compile(f"^ | [{_S}]|[{_S}] | $")

#: Stands for one normalized space among the ids of a lower-case vocabulary; never a token.
SPACE = 0xFFFFFFFF
_LONG = 64


def _byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_LETTERS = str.maketrans(dict(enumerate(_byte_letters())))
_SPACE_LETTER = _byte_letters()[32]
#: Common signs at the end of a word; each is a word of its own.
_STOPS = (".", ",", ";", ":", "!", "?")


class _Bounded(dict):
    """A dictionary that fills itself; beyond most entries those not met lately are forgotten."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, key: str) -> bytes:
        got = self.before.get(key)
        if got is None:
            got = self.make(key)
        if len(key) <= _LONG:
            self[key] = got
        return got

    def all(self, keys: list[str]) -> bytes:
        if len(self) > self.most:
            self.before = dict(self)
            self.clear()
        return b"".join(map(self.__getitem__, keys))


class WordEncoder:
    """Ids of texts under one vocabulary file; remembers at most most words and as many space-delimited chunks.

    spaces: keep SPACE between the chunks of a lower-case vocabulary, so that ids can be aligned with a text.
    """

    def __init__(self, path: str, spaces: bool = False, most: int = 50_000) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.lower = bool(self.suffix)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {k: np.uint32(v).tobytes() for k, v in special.items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
        self.vocab_size = max(max(spec["model"]["vocab"].values()), *special.values()) + 1
        self.tokens = [""] * self.vocab_size
        for token, i in (spec["model"]["vocab"] | special).items():
            self.tokens[i] = token
        self.spaces = spaces
        self.words = _Bounded(self._word, most)
        self.find = (_LOWER_WORDS if self.lower else _BYTE_WORDS).findall
        self.tail = array("I", [SPACE]).tobytes() if spaces else b""
        self.chunks = _Bounded(self._chunk, most)

    def _word(self, word: str) -> bytes:
        """Ids of one word, by the library's merges."""
        if self.lower and word in _WHITE:
            return np.uint32(SPACE).tobytes() if self.spaces else b""
        if word.isascii() and word.isprintable():  # all but the space stand for themselves
            letters = word.replace(" ", _SPACE_LETTER)
        else:
            letters = word.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two spaces; for a byte-level vocabulary with the space before it."""
        body = chunk if self.lower else chunk[1:]
        if body.isalpha():  # one word
            return self.words[chunk] + self.tail
        if chunk[-1:] in _STOPS and body[:-1].isalpha():  # a word and a stop
            return self.words[chunk[:-1]] + self.words[chunk[-1]] + self.tail
        return self.words.all(self.split(chunk) if self.lower else self.find(chunk)) + self.tail

    def normalize(self, text: str) -> str:
        """The text as the splitter of a lower-case vocabulary sees it: white space runs as one space, none at the ends."""
        if _LATE.search(text):
            return self.library.normalizer.normalize_str(text).strip(" ")
        if _CONTROL.search(text):
            return _RUN.sub(" ", text).strip(" ").lower()
        return " ".join(text.lower().split())

    def split(self, text: str) -> list[str]:
        """Words of a normalized text; nothing is left out, spaces stand alone."""
        if not _LATE.search(text.replace("\u0307", "")):
            return self.find(text)
        out, at = [], 0
        for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text):
            out += [" "] * (a - at)
            out.append(text[a:b])
            at = b
        return out + [" "] * (len(text) - at)

    def aligned(self, text: str) -> np.ndarray:
        """Ids of a normalized text, SPACE for each space."""
        return np.frombuffer(self.chunks.all(text.split(" ")), np.uint32)[:-1]

    def ids(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; special strings in it become their special ids, as the library does by default."""
        if not text:
            return np.zeros(0, np.uint32)
        parts = self.split_special.split(text) if "<|" in text else [text]
        return np.frombuffer(b"".join(self.special[p] if k % 2 else self._plain(p) for k, p in enumerate(parts)), np.uint32)

    def _plain(self, text: str) -> bytes:
        if self.lower:
            return self.chunks.all(self.normalize(text).split(" "))
        if _LATE.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if _UNEVEN.search(text):
            return self.words.all(self.find(text))
        return self.chunks.all(text.replace(" ", "\0 ").split("\0"))

    def _alone(self, text: str) -> bool:
        """Whether a text needs a way of its own."""
        if "<|" in text or "\0" in text or not text.isascii() and ("\u0130" in text or _LATE.search(text)):
            return True
        if self.lower:
            return False
        return text[:1] == " " or text[-1:] == " " or "  " in text or "\n " in text or " \n" in text or any(c in text for c in _RARE_WHITE)

    def many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text, in order. Equal chunks of all the texts are looked up once; hand over some MB at a time."""
        alone = {i: self.ids(x) for i, x in enumerate(texts) if self._alone(x)}
        rows = pa.array([x for i, x in enumerate(texts) if i not in alone], pa.large_string())
        if self.lower:
            lists = pc.ascii_split_whitespace(pc.utf8_lower(rows))
        else:
            lists = pc.split_pattern(pc.replace_substring(rows, " ", "\0 "), "\0")
        ids, bounds = self._gather(lists)
        at = 0
        for i in range(len(texts)):
            if i in alone:
                yield alone[i]
            else:
                yield ids[bounds[at] : bounds[at + 1]]
                at += 1

    def many_aligned(self, texts: list[str]) -> Iterator[np.ndarray]:
        """aligned() of every text."""
        ids, bounds = self._gather(pc.split_pattern(pa.array(texts, pa.large_string()), " "))
        for a, b in zip(bounds, bounds[1:], strict=False):
            yield ids[a : b - 1]

    def _gather(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes = lists.flatten().dictionary_encode()
        chunks = codes.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.chunks.get, chunks))
        older = self.chunks.before.get
        for k in [k for k, x in enumerate(ids) if x is None]:
            chunk = chunks[k]
            ids[k] = older(chunk)
            if ids[k] is None:
                ids[k] = self._chunk(chunk)
            if len(chunk) <= _LONG:
                self.chunks[chunk] = ids[k]
        if len(self.chunks) > self.chunks.most or len(self.words) > self.words.most:
            self.chunks.all([])
            self.words.all([])
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        pool = np.frombuffer(b"".join(ids), np.uint32)
        codes = codes.indices.to_numpy()
        each = n[codes]
        ends = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(each, out=ends[1:])
        at = np.repeat((np.cumsum(n) - n)[codes] - ends[:-1], each)
        at += np.arange(len(at))
        return pool[at], ends[lists.offsets.to_numpy()]


def blocks(texts: list[str | None], size: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about size characters together; null counts as empty."""
    block, n = [], 0
    for x in texts:
        block.append(x or "")
        n += len(block[-1])
        if n >= size:
            yield block
            block, n = [], 0
    if block:
        yield block


_TOKENS: dict[str, np.ndarray] = {}


def tokens_of(path: str) -> np.ndarray:
    """The UTF-8 bytes of every token's text, by id; without the rest of an encoder."""
    if path not in _TOKENS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec["added_tokens"]}
        out = np.full(max(vocab.values()) + 1, b"", object)
        for token, i in vocab.items():
            out[i] = token.encode()
        _TOKENS[path] = out
    return _TOKENS[path]


def make_encoder(path: str, spaces: bool = False) -> WordEncoder:
    words = WordEncoder(path, spaces)
    if not words.lower:  # more distinct words, as letter case counts
        words.words.most = words.chunks.most = 150_000
    return words


def encoder(path: str, spaces: bool = False) -> WordEncoder:
    """The encoder of this Python worker."""
    return held(("words", path, spaces), lambda: make_encoder(path, spaces))
