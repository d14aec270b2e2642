"""Token counts (operator 9) by the tokenizers library, with overlap resynchronisation for huge documents.

A document over ``chunk`` characters is encoded in chunks that overlap. Two neighbouring encodings are spliced at a
stable common boundary: a place in the overlap where both start a new pre-token and which white space or a digit proves
to be a border whatever stands around it, the left one having seen a further character. From such a place on both
encodings go the same way, and everything before it is settled in the left one. Where the overlap has no such place,
it is widened until it has one or the document ends. Shorter documents are cut at white space, and the library normalises and
encodes each word once per cache.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import _common as C

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 256
CACHE_ENTRIES = 400_000
#: White space as the library's pattern sees it; str.split() takes the four separators for white space, too.
SPACES = regex.compile(r"\p{White_Space}+")
_DIGITS = frozenset("0123456789")
_SEPARATORS = re.compile("[\x1c-\x1f]")


def _stable(text: str, p: int) -> bool:
    """Whether what stands around ``p`` alone proves that a pre-token ends and another starts there.

    No pre-token has white space, and a digit is one of its own, whatever stands before or after.
    """
    return (text[p - 1].isspace() and not _SEPARATORS.match(text[p - 1])) or text[p - 1] in _DIGITS or text[p] in _DIGITS


class Counter:
    """Token counts of one vocabulary file."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.chunk, self.overlap = chunk, overlap
        special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.special = special
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        self.cache: dict[str, int] = {}

    def short(self, texts: list[str]) -> list[int]:
        """Counts of texts without special strings: sums over words, since no pre-token goes over white space."""
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache.clear()
        words = [SPACES.split(t) if _SEPARATORS.search(t) else t.split() for t in texts]
        cache, new = self.cache, set()
        for w in words:
            new.update(w)
        new = [w for w in new if w not in cache]
        for w, e in zip(new, self.lib.encode_batch_fast(new, add_special_tokens=False), strict=True):
            cache[w] = len(e)
        get = cache.__getitem__
        return [sum(map(get, w)) for w in words]

    def _view(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """Where pre-tokens of a part start, as places in the text, and the tokens before each of them."""
        e = self.lib.encode(text[start:end], add_special_tokens=False)
        starts, before, last = [], [], None
        for k, (w, (a, _)) in enumerate(zip(e.word_ids, e.offsets, strict=True)):
            if w != last:
                starts.append(start + a)
                before.append(k)
                last = w
        return starts, [*before, len(e)]

    def huge(self, text: str) -> int:
        """Count of one text without special strings by spliced chunks."""
        n, total, at, overlap = len(text), 0, 0, self.overlap
        left, counts = self._view(text, 0, min(n, self.chunk + overlap))
        end = min(n, self.chunk + overlap)
        skip = 0  # tokens of the left view before the last splice
        while end < n:
            back = overlap
            while True:
                begin = max(at, end - back)
                right_end = min(n, begin + self.chunk + overlap)
                right, right_counts = self._view(text, begin, right_end)
                common = sorted(p for p in set(left).intersection(right) if begin < p < end and _stable(text, p))
                if common:
                    break
                if begin == at:  # the whole left part has no stable place: one longer part instead
                    end = min(n, end + max(self.chunk, end - at))
                    left, counts = self._view(text, at, end)
                    skip = 0
                    if end == n:
                        return total + counts[-1]
                    back = overlap
                    continue
                back *= 2
            place = common[0]
            total += counts[left.index(place)] - skip
            skip = right_counts[right.index(place)]
            at, left, counts, end = begin, right, right_counts, right_end
            # what lies before the splice in the new view is counted already
            cut = left.index(place)
            left, counts, at = left[cut:], counts[cut:], place
            if end < n and end - at < overlap:
                end = min(n, at + self.chunk + overlap)
                left, counts = self._view(text, at, end)
                skip = 0
        return total + counts[-1] - skip

    def count(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        owners, parts = [], []
        for i, text in enumerate(texts):
            found = self.split.split(text) if any(s in text for s in self.special) else [text]
            out[i] += len(found) // 2  # special strings stand at odd places and are one token each
            for part in found[::2]:
                if len(part) > self.chunk:
                    out[i] += self.huge(part)
                elif part:
                    owners.append(i)
                    parts.append(part)
        for i, n in zip(owners, self.short(parts), strict=True):
            out[i] += n
        return out


_counters: dict[tuple, Counter] = {}


def shared_counter(*key) -> Counter:
    """One counter per worker and parameters, with its cache, for all tasks that the worker runs."""
    if key not in _counters:
        _counters[key] = Counter(*key)
    return _counters[key]


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 2048, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row, in any order.

    A null text counts as empty: no bytes, no tokens. Repeated rows give repeated results; further columns are
    ignored. An empty table gives an empty result.
    """
    C.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared_counter(vocab_path, chunk, overlap)
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                raw = [x.as_py() for x in part.column(1)]
                counts = counter.count([x.decode("utf-8", "replace") for x in raw])
                cols = [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return C.id_and_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
