"""Encoding with vocabularies of the tokenizers library that split at white space, word by word.

Such a vocabulary drops white space and cuts texts into letters, digits and other signs, so
what stands between two spaces can be encoded apart.  The words of a slice of texts that are
not known yet go to the library together, and are kept in a bounded table, since words repeat: of
its two generations the older goes when the younger is full.
"""

from __future__ import annotations

import os
import re
import struct
from functools import cached_property, lru_cache

import numpy as np

from .bpe import byte_alphabet
from .common import release

#: Longest word that is kept in the table.
LONGEST = 64
#: Letters that no normal form composes or splits and whose lower case is one letter, and a run of signs
#: behind them: two matches of the splitting pattern (an apostrophe could begin a third).
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)").fullmatch

#: What often stands behind a word.
_USUAL = ("", ".", ",")


def _one_byte(text: str) -> bool:
    """Whether all characters lie below U+0100, where lower case is one character for each, and normal."""
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordCodec:
    """Encoder of one `.json` vocabulary; ids are little-endian, of as few bytes as hold them all."""

    def __init__(self, path: str, most: int = 450_000):
        self._path, self._most = path, most
        self._of: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._signs: dict[str, bytes] = {}
        self._characters = dict(enumerate(byte_alphabet()))

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self._path)
        release()
        return made

    @cached_property
    def dtype(self) -> str:
        """Type of the stored ids."""
        return "<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    @cached_property
    def _openings(self) -> tuple[str, ...]:
        """First two signs of the added tokens; these may span words, so texts with one are encoded whole."""
        return tuple({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})

    def _packed(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self._letter}", *ids)

    @cached_property
    def _letter(self) -> str:
        return "H" if self.dtype == "<u2" else "I"

    def _ids(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    @cached_property
    def _letters(self):
        """The model alone, for words in the byte alphabet with spaces between them; and which ids end a word."""
        from tokenizers import Tokenizer, pre_tokenizers

        bare = Tokenizer(self.tokenizer.model)
        bare.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        suffix = self.tokenizer.model.end_of_word_suffix
        ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix and t.endswith(suffix)]] = True
        return bare, ends

    def _sign(self, signs: str) -> bytes:
        ids = self._signs.get(signs)
        if ids is None:
            if len(self._signs) > 10_000:
                self._signs.clear()
            ids = self._signs[signs] = self._ids(signs) if signs else b""
        return ids

    def _merged(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters, by one call of the library."""
        bare, ends = self._letters
        spelled = " ".join([w.lower() if w.isascii() else w.lower().encode().decode("latin-1").translate(self._characters) for w in words])
        ids = np.array(bare.encode_batch_fast([spelled])[0].ids)
        raw, size = ids.astype(self.dtype).tobytes(), np.dtype(self.dtype).itemsize
        stops = ((np.flatnonzero(ends[ids]) + 1) * size).tolist()
        if len(stops) != len(words):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that the younger generation doesn't hold, which most of them join; a word with odd signs behind it hardly comes again."""
        if len(self._of) >= self._most:
            self._older, self._of = self._of, {}
        of, older = self._of, self._older
        own, new, later = {}, {}, []
        for word in words:
            ids = older.get(word)
            if ids is None:
                if word.isalpha() and word.isascii():
                    new[word] = None
                    continue
                stem, signs = word[:-1], word[-1:]
                if signs not in _USUAL or not (stem.isalpha() and stem.isascii()):
                    plain = _PLAIN(word)
                    if plain is None:
                        own[word] = self._ids(word)
                        continue
                    stem, signs = plain.groups()
                ids = of.get(stem) or older.get(stem)
                if ids is None and stem:
                    new[stem] = None
                    later.append((word, stem, signs))
                    continue
                ids = (ids or b"") + self._sign(signs)
                if signs not in _USUAL:
                    own[word] = ids
                    continue
            own[word] = of[word] = ids
        if new:
            for stem, ids in zip(new, self._merged(list(new)), strict=True):
                own[stem] = ids
                if len(stem) <= LONGEST:
                    of[stem] = ids
        for word, stem, signs in later:
            own[word] = own[stem] + self._sign(signs)
            if signs in _USUAL and len(word) <= LONGEST:
                of[word] = own[word]
        return own

    def encode_texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts; of a null text none."""
        whole, split = {}, []
        for i, text in enumerate(texts):
            if text and any(x in text for x in self._openings):
                whole[i], text = self._ids(text), None
            elif text and _one_byte(text):
                text = text.lower()
            split.append(text.replace("\n", " ").split(" ") if text else [])
        found = [list(map(self._of.get, parts)) for parts in split]
        gaps = [[at for at, x in enumerate(ids) if x is None] if None in ids else () for ids in found]
        own = self._learn({parts[at] for parts, places in zip(split, gaps, strict=True) for at in places}) if any(gaps) else {}
        for parts, ids, places in zip(split, found, gaps, strict=True):
            for at in places:
                ids[at] = own[parts[at]]
        return [whole[i] if i in whole else b"".join(ids) for i, ids in enumerate(found)]

    def encode_bytes(self, text: str) -> bytes:
        """The ids of a whole text."""
        return self.encode_texts([text])[0]


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    """One codec for each vocabulary and worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCodec(path)
