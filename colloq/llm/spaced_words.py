"""Whole-text token ids from memoised spaced words.

A text is cut before every space that a non-space follows. No match of the GPT-2 style
pre-token pattern can cross such a cut, so the ids of a text are the ids of its spaced words
one after another, and a spaced word need be encoded only once per worker. Pre-tokens are then
merged by the library's own model. A text that holds the content of an added token (such as
``<|endoftext|>``) goes through the library whole, which gives that token its own id. Ids are kept
as little-endian uint16; a vocabulary with an id of 65,536 or more is refused with ValueError.
"""

from __future__ import annotations

import re
from array import array
from operator import attrgetter

#: Spaced words that one worker remembers (about 250 bytes each); later ones are encoded again.
MEMO_WORDS = 400_000
#: Words longer than this are encoded but never remembered.
MEMO_CHARS = 64

_MARK = "\x01"
#: Letters, numbers and white space below U+0250.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_N = "0-9²³¹¼-¾"
_S = "\t-\r \u0085 "
_LATIN_PATTERN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
_LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
#: Characters whose lower-case or composed form is the library's business.
_BEYOND = re.compile("[İɐ-\U0010ffff]")
_CUT = re.compile(r"(?= \S)")


class _Unsafe(Exception):
    """A spaced word after whose space more white space follows; the text needs the exact cut."""


def cut(text: str) -> list[str]:
    """``text`` as spaced words; ``''.join`` gives the text again."""
    if _MARK not in text:
        parts = text.replace(" ", _MARK + " ").split(_MARK)
        if not any(p == " " or p[1:2].isspace() and p[0] == " " for p in parts):
            return parts
    return _CUT.split(text)


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for U+0100 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in keep}
    return out | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in out)}


class Memo(dict):
    """Spaced word -> its ids as bytes."""

    def __init__(self, encode_word, most: int):
        super().__init__()
        self.encode_word, self.most = encode_word, most
        self.added = encode_word.added
        self.line = encode_word("\n")
        self.marks = {c: encode_word(c) for c in ".,!|?;:"}

    def __missing__(self, word: str) -> bytes:
        if word == " " or word[:1] == " " and word[1:2].isspace():
            raise _Unsafe
        if "\n" in word and len(parts := word.split("\n")) == 2 and all(parts) and not (parts[0][-1].isspace() or parts[1][0].isspace()):
            # A single line break between non-spaces is a pre-token of its own; such words hardly come again.
            return self[parts[0]] + self.line + self[parts[1]]
        mark = self.marks.get(word[-1:])
        if mark and (last := word[-2:-1]).isalnum() and last < "ɐ" and last != "İ" and (stem := self.get(word[:-1])):
            ids = stem + mark  # a mark after a letter or digit is a pre-token of its own
        else:
            ids = self.encode_word(word)
        if len(self) < self.most and len(word) <= MEMO_CHARS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian uint16 ids of the whole text."""
        if not text:
            return b""
        for token in self.added:
            if token in text:
                return self.encode_word.whole(text)
        text = self.encode_word.normal(text)
        if _MARK not in text:
            try:
                return b"".join(map(self.__getitem__, text.replace(" ", _MARK + " ").split(_MARK)))
            except _Unsafe:
                pass
        return b"".join([self.encode_word(w) for w in _CUT.split(text)])


_ID = attrgetter("id")


class _LibraryEncoder:
    """ids of spaced words by a vocabulary file of the ``tokenizers`` library.

    Words below U+0250 are split here and merged by the library's model; all others go through
    the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if max(self.library.get_vocab(with_added_tokens=True).values(), default=0) >= 1 << 16:
            raise ValueError(f"{path}: ids beyond 16 bits")
        added = self.library.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError(f"{path}: added tokens that match normalized text")
        self.added = [t.content for t in added]
        self.tokenize = self.library.model.tokenize
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x250)}
        self.marks: dict[str, list[int]] = {}

    def piece(self, piece: str) -> list[int]:
        return list(map(_ID, self.tokenize(piece.translate(self.letters))))

    def short(self, piece: str) -> list[int]:
        known = self.marks.get(piece)
        if known is None:
            known = self.marks[piece] = self.piece(piece)
        return known

    def pieces(self, word: str) -> list[str]:
        raise NotImplementedError

    def normal(self, text: str) -> str:
        """A text of fewer different words with the same ids."""
        return text

    def whole(self, text: str) -> bytes:
        return array("H", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def spaced(self, word: str) -> str:
        """The model's letters for a space and ASCII letters after it."""
        raise NotImplementedError

    def __call__(self, word: str) -> bytes:
        if word.isascii():
            if word[:1] == " " and word[1:].isalpha():
                return array("H", map(_ID, self.tokenize(self.spaced(word)))).tobytes()
        elif max(word) >= "ɐ" or "İ" in word:
            return self.whole(word)
        ids = []
        for p in self.pieces(word):
            ids += self.piece(p) if len(p) > 2 else self.short(p)
        return array("H", ids).tobytes()


class ByteLevelEncoder(_LibraryEncoder):
    """Byte-level BPE: a space belongs to the word after it."""

    def spaced(self, word: str) -> str:
        return "Ġ" + word[1:]

    def pieces(self, word: str) -> list[str]:
        if word[:1] == " ":
            if word[1:].isalpha():
                return [word]
            if word[1:-1].isalpha() and word[-1] in ".,!|":
                return [word[:-1], word[-1]]
        return _LATIN_PATTERN.findall(word)


class WordEndEncoder(_LibraryEncoder):
    """Lower-casing BPE with word ends; white space is dropped.

    Below U+0250 precomposed letters are in NFC and lower() works letter by letter, but for
    U+0130, which goes through the library.
    """

    def normal(self, text: str) -> str:
        return text if _BEYOND.search(text) else text.lower()

    def spaced(self, word: str) -> str:
        return word[1:].lower()

    def pieces(self, word: str) -> list[str]:
        word = word.lower()
        if word[:1] == " ":
            if word[1:].isalpha():
                return [word[1:]]
            if word[1:-1].isalpha() and word[-1] in ".,!|":
                return [word[1:-1], word[-1]]
        return _LATIN_WORDS.findall(word)


_MEMOS: dict[tuple[str, str], Memo] = {}


def memo(kind: str, path: str, most: int = MEMO_WORDS) -> Memo:
    """This worker's memo of ``most`` words for a vocabulary file; ``kind`` is ``byte`` or ``word``."""
    if (kind, path) not in _MEMOS:
        encoder = {"byte": ByteLevelEncoder, "word": WordEndEncoder}[kind]
        _MEMOS[kind, path] = Memo(encoder(path), most)
    _MEMOS[kind, path].most = most
    return _MEMOS[kind, path]
