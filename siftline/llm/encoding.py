"""Token ids from public vocabulary files, one distinct part of a text at a time.

Both vocabularies split a text before they merge, so a text's ids are the ids of
its parts. Words repeat, so each worker process keeps the ids of the parts it
has met, up to a fixed number, and merges only new ones. Wherever a split here
could differ from the library's own, the library gets the whole text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from siftline.llm.storage import held

#: Distinct parts, and their bytes, that a worker process keeps before its cache
#: starts afresh. A part costs its letters, its ids and some 400 bytes of tables.
CACHE, CACHE_BYTES, PART_BYTES = 600_000, 256 << 20, 400
#: Adjacent white space, and white space other than blanks and line ends.
_JOINED = ("  ", " \n", "\n ")
_OTHER_SPACE = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0")
_CONTRACTED = "'s|'t|'re|'ve|'m|'ll|'d"
#: The vocabularies' own splits, for Latin-1 letters (fixed values).
_LETTER, _DIGIT = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾"
_WORDS_ONLY = re.compile(rf"{_CONTRACTED}|[{_LETTER}]+|[{_DIGIT}]|[^\s{_LETTER}{_DIGIT}]+")
_WITH_BLANK = re.compile(rf"{_CONTRACTED}| ?[{_LETTER}]+| ?[{_DIGIT}]+| ?[^\s{_LETTER}{_DIGIT}]+|\s+(?!\S)|\s+")


@lru_cache(maxsize=1)
def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves,
    the others for the letters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class _Index(dict):
    """Numbers parts in the order of their first use and remembers new ones."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = number = len(self)
        self.new.append(part)
        return number


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.model = self.library.model
        #: White space has no ids and joins nothing: parts are bare words.
        self.words_only = not self.library.encode(" \n", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.index, self.ids, self.ends = _Index(), array("I"), array("q", [0])
        #: A word and the same word before a comma share their merge.
        self.pieces: dict[str, list[int]] = {}
        self.size = 0

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _of_part(self, part: str) -> Iterable[int]:
        """Ids of a part: Latin-1 is split here and merged by the library's model."""
        if not part.isascii():
            try:
                part.encode("latin-1")
            except UnicodeEncodeError:
                return self.whole(part)
        if "<|" in part or not part.replace("\n", "").isprintable():
            return self.whole(part)
        pieces = _WORDS_ONLY.findall(part.lower()) if self.words_only else _WITH_BLANK.findall(part)
        letters, found = byte_letters(), []
        for piece in pieces:
            ids = self.pieces.get(piece)
            if ids is None:
                plain = piece.isascii() and " " not in piece and piece.isprintable()
                ids = self.pieces[piece] = [t.id for t in self.model.tokenize(piece if plain else "".join([letters[b] for b in piece.encode()]))]
            found += ids
        return found

    def _learn(self) -> None:
        for part in self.index.new:
            self.ids.extend(self._of_part(part))
            self.ends.append(len(self.ids))
            self.size += PART_BYTES + 2 * len(part)
        self.index.new = []

    @staticmethod
    def _odd(text: str) -> bool:
        """Whether Python would also split at white space beyond ASCII's."""
        try:
            text.isascii() or text.encode("latin-1")
        except UnicodeEncodeError:
            return True
        return any(c in text for c in _OTHER_SPACE[4:])

    def _parts(self, text: str) -> list[str]:
        if self.words_only:
            # Only ASCII white space is a split here; the rest is the model's affair.
            return re.split(r"[ \t-\r]+", text) if self._odd(text) else text.split()
        try:
            text.isascii() or text.encode("latin-1")
            apart = not any(s in text for s in _JOINED) and not any(c in text for c in _OTHER_SPACE)
        except UnicodeEncodeError:
            apart = False
        if not apart:  # cut before a lone blank between words; runs stay whole
            return re.split(r"(?<=\S)(?= \S)", text)
        first, *rest = text.split(" ")
        return [first, *[" " + p for p in rest]]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text begins.

        A null is an empty text. There is one more start than there are texts.
        """
        if len(self.index) > CACHE or self.size > CACHE_BYTES:
            self._clear()
        numbers, counts, known = array("i"), [0], self.index.__getitem__
        for text in texts:
            if text:
                numbers.extend(map(known, self._parts(text)))
            counts.append(len(numbers))
        self._learn()
        ends, ids = np.array(self.ends), np.frombuffer(self.ids, dtype=np.uint32) if self.ids else np.zeros(0, np.uint32)
        chosen = np.frombuffer(numbers, dtype=np.int32) if numbers else np.zeros(0, np.int32)
        first = ends[chosen]
        total = np.concatenate([[0], np.cumsum(ends[chosen + 1] - first)])
        at = np.arange(total[-1]) + np.repeat(first - total[:-1], np.diff(total))
        return ids[at], total[counts]


def encoder(path: str) -> Encoder:
    """One encoder and cache for each worker process, until another operator runs."""
    return held(f"encoder {path}", lambda: Encoder(path))
