"""Byte-level BPE encoding and decoding with the tokenizers library.

A text is cut only where a single space stands between two characters that are not
white space: there the splitting pattern always begins a new match, so the parts can
be encoded apart and the results joined.  Distinct parts are encoded once by the
tokenizers library and kept in a bounded table, since words repeat.
"""

from __future__ import annotations

import base64
import os
import re
import struct
from functools import cached_property, lru_cache

import numpy as np

from .common import release

#: Entries of each table of known strings.  A full table of parts becomes the older of two generations, others are emptied.
MEMO_ENTRIES = 250_000

#: The space in the byte alphabet.
SPACE = "\u0120"

#: Spaces beside other white space, where a text cannot be cut, and the safe cuts.
_UNSAFE = re.compile(r" (?:(?<=\s )|(?=\s))")
_SAFE_CUT = re.compile(r"(?<=\S) (?=\S)")


def byte_alphabet() -> list[str]:
    """Character that stands for each byte: printable bytes stand for themselves, the
    rest for the code points from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _from_ranks(path: str):
    """A tokenizers model that merges as the rank file demands: any two neighbours whose
    concatenation is a token may merge, lowest rank first."""
    from tokenizers import Tokenizer, models

    ranks = read_ranks(path)
    alphabet = byte_alphabet()
    spelled = {token: "".join(alphabet[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda item: item[1]):
        for cut in range(1, len(token)):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                merges.append((spelled[left], spelled[right]))
    return Tokenizer(models.BPE(vocab={spelled[t]: r for t, r in ranks.items()}, merges=merges))


class Codec:
    """Encoder and decoder of one byte-level vocabulary: a `.tiktoken` rank file or a
    `.json` file of the tokenizers library; `pattern` splits texts before the merges.  With
    `added`, the library's added tokens inside a text get their own ids, as by its `encode`."""

    def __init__(self, path: str, pattern: str, added: bool = False):
        self._path, self._pattern, self._with_added = path, pattern, added
        self._characters = dict(enumerate(byte_alphabet()))
        self._of_piece: dict[str, bytes] = {}
        self._of_part: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._length: dict[str, int] = {}
        self._blobs: np.ndarray | None = None

    @cached_property
    def tokenizer(self):
        """Needed for encoding alone, so that decoding workers stay small."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self._path) if self._path.endswith(".json") else _from_ranks(self._path)
        release()
        return made

    @cached_property
    def _added(self):
        """Finds an added token in a text; None if there are none to look for."""
        found = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if self._with_added else []
        return re.compile("|".join(map(re.escape, found))).search if found else None

    @cached_property
    def _merge(self):
        return self.tokenizer.model.tokenize

    @cached_property
    def _pieces(self):
        import regex

        return regex.compile(self._pattern).findall

    def _ids(self, spelled: str) -> bytes:
        """Ids of one match of the pattern, spelled in the byte alphabet."""
        tokens = [token.id for token in self._merge(spelled)]
        return struct.pack(f"<{len(tokens)}I", *tokens)

    def _piece(self, piece: str) -> bytes:
        """Ids of one match of the pattern."""
        ids = self._of_piece.get(piece)
        if ids is None:
            if len(self._of_piece) >= MEMO_ENTRIES:
                self._of_piece.clear()
            ids = self._of_piece[piece] = self._ids(piece.encode().decode("latin-1").translate(self._characters))
        return ids

    def _part(self, part: str) -> bytes:
        """Ids of a space and the part behind it.  A word is one match, and kept as a part alone."""
        if part.isalpha():
            return self._ids(SPACE + (part if part.isascii() else part.encode().decode("latin-1").translate(self._characters)))
        if part[-1:] in (".", ",") and part[:-1].isalpha():
            return (self._of_part.get(part[:-1]) or self._older.get(part[:-1]) or self._part(part[:-1])) + self._piece(part[-1])
        return b"".join(map(self._piece, self._pieces(" " + part)))

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._added and self._added(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        safe = text[0] != " " and text[-1] != " " and not _UNSAFE.search(text)
        parts = text.split(" ") if safe else _SAFE_CUT.split(text)
        head = b"".join(map(self._piece, self._pieces(parts[0])))
        found = list(map(self._of_part.get, parts))
        found[0] = head
        if None in found:
            if len(self._of_part) >= MEMO_ENTRIES:
                self._older, self._of_part = self._of_part, {}
            for at, ids in enumerate(found):
                if ids is None:
                    part = parts[at]
                    found[at] = self._of_part[part] = self._older.get(part) or self._part(part)
        return b"".join(found)

    def spelled_matches(self, text: str) -> list[str]:
        """The matches of the pattern, spelled in the byte alphabet."""
        return [p.encode().decode("latin-1").translate(self._characters) for p in self._pieces(text)]

    def encode_once(self, text: str) -> bytes:
        """The ids of a text of which no added token counts, without looking into the tables of known strings."""
        return b"".join(map(self._ids, self.spelled_matches(text)))

    def token_bytes(self) -> list[bytes]:
        """What each id stands for."""
        if self._blobs is None:
            self._table()
        raw = self._blobs.tobytes()
        return [raw[a : a + n] for a, n in zip(self._starts.tolist(), self._sizes.tolist(), strict=True)]

    def count(self, text: str) -> int:
        """How many ids the text has."""
        if not text:
            return 0
        if self._added and self._added(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        safe = text[0] != " " and text[-1] != " " and not _UNSAFE.search(text)
        parts = text.split(" ") if safe else _SAFE_CUT.split(text)
        found = list(map(self._length.get, parts))
        if None in found:
            if len(self._length) >= 700_000:
                self._length.clear()
            for at, n in enumerate(found):
                if n is None:
                    found[at] = self._length[parts[at]] = self._count_part(" " + parts[at])
        if parts[0]:  # no space before the first part
            found[0] = self._count_part(parts[0])
        return sum(found)

    def _count_part(self, part: str) -> int:
        pieces = (part,) if part[1:].isalpha() and part[0] in " abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" else self._pieces(part)
        return sum(len(self._merge(p.encode().decode("latin-1").translate(self._characters))) for p in pieces)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4")

    # decoding -----------------------------------------------------------------

    def _table(self) -> None:
        """Bytes of all tokens, one after another, and where each begins."""
        if self._path.endswith(".json"):
            value = {c: b for b, c in enumerate(byte_alphabet())}
            special = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
            tokens = [
                special[i].encode() if i in special else bytes(value[c] for c in self.tokenizer.id_to_token(i) or "")
                for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))
            ]
        else:
            known = {rank: token for token, rank in read_ranks(self._path).items()}
            tokens = [known.get(i, b"") for i in range(max(known) + 1)]
        self._sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self._starts = np.concatenate([[0], np.cumsum(self._sizes)[:-1]])
        self._blobs = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for; a token may end within a character."""
        if self._blobs is None:
            self._table()
        ids = ids.astype(np.int64)
        sizes = self._sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids) or not ends[-1]:
            return b""
        at = np.arange(ends[-1]) + np.repeat(self._starts[ids] - (ends - sizes), sizes)
        return self._blobs[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of the ids.  A character split over tokens is put together again; bytes
        that form no character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")

    def offsets(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and one-past-last character of each token in the text it came from.  A
        character split over tokens belongs to all of them."""
        raw = np.frombuffer(self.decode_bytes(ids), dtype=np.uint8)
        ends = np.cumsum(self._sizes[ids.astype(np.int64)]) if len(ids) else np.zeros(0, np.int64)
        begins = ends - (self._sizes[ids.astype(np.int64)] if len(ids) else 0)
        leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before byte i
        return np.maximum(leads[np.minimum(begins + 1, len(raw))] - 1, 0), leads[ends]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str, added: bool = False) -> Codec:
    """One codec for each vocabulary and worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Codec(path, pattern, added)
