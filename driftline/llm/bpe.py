"""BPE encoding and decoding (operator 2).

Encoding walks each pre-token from the left and takes the longest vocabulary token at each place, found for all places
in one Aho-Corasick pass. A token is accepted only if it is compatible with the one before it, that is, if merging the
two tokens' bytes by rank would give just these two; otherwise a shorter token is tried, and where none is left the
walk steps back and marks the place as a dead end. Each place is marked at most once, so the work is linear in the
text, and the result is the exact merge result. Decoding looks up every id's bytes in one table of offsets.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _common as C
from ._vocab import PIECES, read_vocabulary, special_pattern, spelled, units

#: Entries that a worker keeps of pre-tokens and of pair checks; the cache starts anew beyond it.
CACHE_ENTRIES = 300_000


class PieceCache(dict):
    """Pre-token to packed ids; what is missing is encoded on first use."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        out = self[piece] = self.make(piece)
        return out


class UnitCache(dict):
    """Unit between white space to packed ids. A mark after a letter or digit is a pre-token of its own, so units that
    end with one are put together from the rest and the mark, and not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.marks = {c: encode(c.encode()) for c in ".,;:!?|"}

    def __missing__(self, unit: str) -> bytes:
        mark = self.marks.get(unit[-1:])
        if mark is not None and unit[-2:-1].isalnum():
            return self[unit[:-1]] + mark
        if unit.isascii() and unit.isalpha():
            out = self.encode(b" " + unit.encode())
        else:
            out = b"".join([self.encode(p.encode("utf-8")) for p in PIECES.findall(spelled(unit))])
        self[unit] = out
        return out


class BacktrackingEncoder:
    """Exact BPE of one vocabulary by longest matches and pair compatibility."""

    def __init__(self, path: str):
        self.tokens, self.pairs, self.special = read_vocabulary(path)
        self.split = special_pattern(self.special)
        specials = set(self.special.values())
        self.size = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.size)])
        self.blob = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.halves: dict[int, tuple[int, int]] = {made: pair for pair, made in self.pairs.items()}
        self.known: dict[tuple[int, int], bool] = {}
        usable = [i for i, t in enumerate(self.tokens) if t and i not in specials and self._whole(i)]
        self.by_bytes = {self.tokens[i]: i for i in usable}
        self.shorter = {i: self._next_shorter(self.tokens[i]) for i in usable}
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.tokens[i].decode("latin-1"), (i, len(self.tokens[i])))
        self.automaton.make_automaton()
        self.cache = PieceCache(lambda piece: self._packed(piece.encode("utf-8")))
        self.unit_cache = UnitCache(self._packed)

    def _whole(self, token: int) -> bool:
        """Whether the token's own bytes encode to it: no better merge crosses the place where its halves meet."""
        if token not in self.halves:
            return len(self.tokens[token]) == 1
        left, right = self.halves[token]
        return self._apart(left, right, token)

    def _next_shorter(self, text: bytes) -> int | None:
        return next((self.by_bytes[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.by_bytes), None)

    def _apart(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge of id under ``limit`` joins bytes of the two tokens while each is being built.

        Undoing merges from the latest back gives the states in which the border was seen; the merge that would cross
        it in a state must not come before the merge that ended this state.
        """
        while True:
            made = self.pairs.get((left, right))
            if made is not None and made < limit:
                return False
            undo_left, undo_right = self.halves.get(left), self.halves.get(right)
            if undo_left is None and undo_right is None:
                return True
            if undo_right is None or (undo_left is not None and left > right):
                limit, left = left, undo_left[1]
            else:
                limit, right = right + 1, undo_right[0]

    def compatible(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= CACHE_ENTRIES // 2:
                self.known.clear()
            found = self.known[key] = self._apart(left, right, 1 << 60)
        return found

    def encode_bytes(self, text: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.by_bytes.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest = [0] * n
        for end, (token, size) in self.automaton.iter(text.decode("latin-1")):
            longest[end - size + 1] = token  # ends rise, so the last one at a start is the longest
        alive = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        size, at, token = self.size, 0, longest[0]
        while True:
            end = at + len(self.tokens[token])
            if alive[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at == n:
                    return out
                token = longest[at]
                continue
            shorter = self.shorter[token]
            while shorter is None:  # a dead end: step back
                alive[at] = 0
                token = out.pop()
                at -= int(size[token])
                shorter = self.shorter[token]
            token = shorter

    def _packed(self, piece: bytes) -> bytes:
        ids = self.encode_bytes(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; special strings in it give their ids."""
        for cache, most in ((self.cache, CACHE_ENTRIES // 8), (self.unit_cache, CACHE_ENTRIES)):
            if len(cache) >= most:
                cache.clear()
        get = self.cache.__getitem__
        if not any(s in text for s in self.special):
            cut = units(text)
            if cut is None:
                return b"".join(map(get, PIECES.findall(text)))
            return b"".join([*map(get, PIECES.findall(cut[0])), *map(self.unit_cache.__getitem__, cut[1])])
        parts = []
        for k, part in enumerate(self.split.split(text)):
            parts += [self.special[part].to_bytes(4, "little")] if k % 2 else map(get, PIECES.findall(part))
        return b"".join(parts)

    def decode_packed(self, packed: bytes) -> bytes:
        """The bytes of the ids, gathered through the offset table; a text's memory is bounded block by block."""
        ids, out = np.frombuffer(packed, dtype="<u4"), []
        for k in range(0, len(ids), 1 << 18):
            block = ids[k : k + (1 << 18)]
            sizes = self.size[block]
            ends = np.cumsum(sizes)
            if len(block):
                place = np.repeat(self.offset[block] - (ends - sizes), sizes)
                place += np.arange(ends[-1])
                out.append(self.blob[place].tobytes())
        return b"".join(out)


_encoders: dict[str, BacktrackingEncoder] = {}


def encoder(path: str) -> BacktrackingEncoder:
    """One encoder per worker and vocabulary file."""
    if path not in _encoders:
        _encoders[path] = BacktrackingEncoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, vocab_path: str, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` (packed) and ``decoded``.

    One row for each input row, in any order. A null text counts as empty: no ids, digests of nothing. Repeated rows
    give repeated results; further input columns are ignored, so their names cannot clash. Bytes that are not UTF-8
    are read as U+FFFD. An empty table gives an empty result.
    """
    C.ship(docs.sparkSession)
    more = ", ids binary, decoded string" if with_ids else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab_path)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                part = batch.slice(k, 512)
                counts, digests, back, ids, texts = [], [], [], [], []
                for raw in part.column(1):
                    packed = enc.encode_packed(raw.as_py().decode("utf-8", "replace"))
                    decoded = enc.decode_packed(packed)
                    counts.append(len(packed) // 4)
                    digests.append(hashlib.sha256(packed).hexdigest())
                    back.append(hashlib.sha256(decoded).hexdigest())
                    if with_ids:
                        ids.append(packed)
                        texts.append(decoded.decode("utf-8", "replace"))
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    cols += [pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)
        C.trim()

    return C.id_and_bytes(docs, id_col, text_col).mapInArrow(run, f"doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
