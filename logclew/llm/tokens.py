"""Tokenising whole texts word by word, with a bounded store of words already encoded.

Neither vocabulary used here joins across white space, so the ids of a text are those
of its words in order. Words are cut at ASCII white space only; whatever else a
tokeniser takes for white space stays inside a word and is left to it. A worker keeps
the words it has met (at most ``STORE_WORDS``, then it starts anew), since most words of
a text are common ones.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterable
from functools import lru_cache


# Bounds a worker's memory: about 200 bytes a word.
STORE_WORDS = 500_000
# Longer words are encoded each time they occur.
STORE_BYTES = 64


def packed(kind: str, ids: list[int]) -> bytes:
    """``ids`` as little-endian numbers: H of 16 bits, I of 32."""
    numbers = array(kind, ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class WordStore(dict):
    """Ids of words as little-endian bytes, encoded when first asked for."""

    def __init__(self, encode: Callable[[list[bytes]], list[bytes]]):
        super().__init__()
        self._encode = encode

    def __missing__(self, word: bytes) -> bytes:
        (ids,) = self._encode([word])
        if len(word) <= STORE_BYTES:
            if len(self) >= STORE_WORDS:
                self.clear()
            self[word] = ids
        return ids

    def learn(self, words: Iterable[bytes]) -> None:
        """Encode the new ones of ``words`` in one call, which some encoders do much faster."""
        new = [w for w in words if w not in self and len(w) <= STORE_BYTES]
        if len(self) + len(new) > STORE_WORDS:
            self.clear()
        self.update(zip(new, self._encode(new), strict=True))


@lru_cache(maxsize=2)
def piece_store(path: str) -> WordStore:
    """Ids of words, each with the leading blank mark, as unsigned 16-bit numbers."""
    processor = pieces(path)
    if processor.vocab_size() > 1 << 16:
        raise ValueError("a vocabulary of at most 65,536 pieces is asked for")

    def encode(words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8") for w in words]
        return [packed("H", x) for x in processor.encode(texts, num_threads=1)]

    return WordStore(encode)


@lru_cache(maxsize=2)
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


# Characters whose lower case is one letter of the same kind and which no normal form
# combines or splits: the letters of Latin-1.
_LATIN = "a-zA-ZÀ-ÖØ-Þß-öø-ÿ"
_PLAIN = re.compile(f"([{_LATIN}]+)?([!-&(-/:-@\\[-`{{-~]+)?")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable,
    else the next free code point from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def word_store(path: str, specials_as_text: bool = False) -> WordStore:
    """Ids of words by a vocabulary with word ends, as unsigned 32-bit numbers.

    The tokeniser is taken as it is loaded: a special token's name in a text gives its id. With
    ``specials_as_text`` it is text like any other, and no text can write a control id.

    Words of Latin letters, punctuation or the one after the other, nearly all there
    are, go to the model directly, lower-cased and with bytes written as its letters;
    letters and punctuation are encoded apart, as the tokeniser cuts them. All
    other words go through the whole tokeniser.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = specials_as_text
    model, letters = tokenizer.model, byte_letters()
    parts: dict[str, bytes] = {}

    def part(text: str) -> bytes:
        ids = parts.get(text)
        if ids is None:
            spelt = text.encode("utf-8").decode("latin-1").translate(letters)
            ids = packed("I", [t.id for t in model.tokenize(spelt)])
            if len(parts) >= STORE_WORDS:
                parts.clear()
            if len(text) <= STORE_BYTES:
                parts[text] = ids
        return ids

    def encode(words: list[bytes]) -> list[bytes]:
        out = []
        for word in words:
            text = word.decode("utf-8")
            plain = _PLAIN.fullmatch(text)
            if plain:
                letter, mark = plain.groups()
                out.append((part(letter.lower()) if letter else b"") + (part(mark) if mark else b""))
            else:
                whole = tokenizer.encode(text, add_special_tokens=False).ids
                out.append(packed("I", whole))
        return out

    return WordStore(encode)
