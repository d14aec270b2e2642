"""Token-ID / binary output (operator 4): patched frame-of-reference blocks.

File format. The output is a Parquet folder; each row is one segment of whole documents in ascending ``doc_id`` order:

``shard``        first document id of the write task (null ids sort first, as the least long)
``seg``          number of the segment in its shard
``before``       ids of the shard before this segment
``n_tokens``     ids of the segment
``doc_ids``      little-endian int64 for each document, ``doc_null`` one byte each (1: the id was null)
``doc_sizes``    little-endian int64: ids of each document, with the end id
``block_starts`` little-endian uint32: where each block begins in ``body``
``body``         the blocks

A block holds up to ``BLOCK`` ids: uint32 minimum, uint8 width, uint16 number of ids less one, uint16 exceptions, the
low ``width`` bits of (id - minimum) for each id packed from the lowest bit on, then the exceptions' places (uint16)
and their (id - minimum) in full (uint32). The width covers ``percentile`` of the block's values.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C
from ._vocab import PIECES, byte_letters, spelled, units

BLOCK = 4096
SEGMENT_IDS = 1 << 19
CACHE_ENTRIES = 500_000
LEAST = -(1 << 63)
FORMAT = (
    "shard long, seg long, before long, n_tokens long, doc_ids binary, doc_null binary, doc_sizes binary, "
    "block_starts binary, body binary"
)
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("last", "<u2"), ("n_out", "<u2")])


@functools.lru_cache(maxsize=64)
def _layout(n: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``n`` values of ``width`` bits: the 32-bit word and the bit where each begins, and the first value of each word."""
    place = np.arange(n, dtype=np.int64) * width
    word = place >> 5
    return word, (place & 31).astype(np.uint64), np.flatnonzero(np.diff(word, prepend=-1))


def _packed(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after the other from the lowest bit on."""
    n = len(values)
    if width == 0:
        return b""
    _, bit, firsts = _layout(n, width)
    wide = (values.astype(np.uint64) & np.uint64((1 << width) - 1)) << bit
    words = np.zeros(len(firsts) + 1, dtype=np.uint64)
    words[:-1] = np.add.reduceat(wide & np.uint64(0xFFFFFFFF), firsts)  # bits of values do not overlap
    words[1:] += np.add.reduceat(wide >> np.uint64(32), firsts)
    return words.astype("<u4").tobytes()[: (n * width + 7) // 8]


def _unpacked(body: bytes, start: int, n: int, width: int) -> np.ndarray:
    if width == 0:
        return np.zeros(n, dtype=np.uint32)
    word, bit, firsts = _layout(n, width)
    size = (n * width + 7) // 8
    words = np.zeros(len(firsts) + 1, dtype="<u4")
    words.view(np.uint8)[:size] = np.frombuffer(body, np.uint8, size, start)
    wide = words.astype(np.uint64)
    pairs = wide[:-1] | (wide[1:] << np.uint64(32))
    return ((pairs[word] >> bit) & np.uint64((1 << width) - 1)).astype(np.uint32)


def pack_blocks(ids: np.ndarray, percentile: float) -> tuple[bytes, np.ndarray]:
    """The blocks of ``ids`` and where each begins."""
    parts, starts, at = [], [], 0
    for k in range(0, len(ids), BLOCK):
        block = ids[k : k + BLOCK].astype(np.uint32)
        low = block.min()
        rest = block - low
        nth = min(len(rest) - 1, int(len(rest) * percentile / 100))
        width = int(np.partition(rest, nth)[nth]).bit_length()
        places = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
        head = np.array([(low, width, len(block) - 1, len(places))], dtype=HEAD)
        part = head.tobytes() + _packed(rest, width) + places.astype("<u2").tobytes() + rest[places].astype("<u4").tobytes()
        starts.append(at)
        parts.append(part)
        at += len(part)
    return b"".join(parts), np.array(starts, dtype="<u4")


def unpack_block(body: bytes, start: int) -> np.ndarray:
    """The ids of the block that begins at ``start``."""
    low, width, last, n_out = np.frombuffer(body, HEAD, 1, start)[0].tolist()
    at, n = start + HEAD.itemsize, last + 1
    rest = _unpacked(body, at, n, width)
    at += (n * width + 7) // 8
    rest[np.frombuffer(body, "<u2", n_out, at)] = np.frombuffer(body, "<u4", n_out, at + 2 * n_out)
    return rest + np.uint32(low)


class LibraryEncoder(dict):
    """Ids of whole texts from the tokenizers library; maps a unit between white space to its packed ids.

    Units are cut as the library's pre-tokenizer cuts them and go to the library's BPE model once per cache. Texts
    with special strings, or with runs of white space, go to the library as they are.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.tokenize = self.lib.model.tokenize
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.letters = {b: c for c, b in byte_letters().items()}
        self.blank = self.letters[32]
        self.marks = {c: np.array(self.lib.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() for c in ".,;:!?|"}

    def __missing__(self, unit: str) -> bytes:
        mark = self.marks.get(unit[-1:])
        if mark is not None and unit[-2:-1].isalnum():  # a mark after a letter or digit is a pre-token of its own
            return self[unit[:-1]] + mark
        if unit.isascii() and unit.isalpha():
            ids = [t.id for t in self.tokenize(self.blank + unit)]
        else:
            ids = [t.id for p in PIECES.findall(spelled(unit)) for t in self.tokenize("".join(map(self.letters.__getitem__, p.encode("utf-8"))))]
        out = self[unit] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        get = self.__getitem__
        cuts = [None if any(s in t for s in self.special) else units(t) for t in texts]
        firsts = self.lib.encode_batch_fast([t if c is None else c[0] for t, c in zip(texts, cuts, strict=True)], add_special_tokens=False)
        firsts = [np.array(e.ids, dtype="<u4").tobytes() for e in firsts]
        return [f if c is None else b"".join([f, *map(get, c[1])]) for f, c in zip(firsts, cuts, strict=True)]


_encoders: dict[str, LibraryEncoder] = {}


def encoder(path: str) -> LibraryEncoder:
    """One encoder per worker and vocabulary file, with its cache, for all tasks that the worker runs."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]


def write_token_file(docs: DataFrame, vocab_path: str, out: str, end_id: int = 2, percentile: float = 95.0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text and write the token file to the folder ``out``.

    Documents are in ascending ``doc_id`` order over the shards; null ids come first and repeated ids are in the order
    of their texts' hashes and texts. A null text counts as empty and has the end id alone. Further columns are
    ignored. An empty table gives an empty file.
    """
    C.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(vocab_path), int(end_id).to_bytes(4, "little")
        shard, seg, before = None, 0, 0
        ids: list[int | None] = []
        packed: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(packed), dtype="<u4")
            body, starts = pack_blocks(flat, percentile)
            row = [
                shard, seg, before, len(flat),
                np.array([i or 0 for i in ids], "<i8").tobytes(), bytes(i is None for i in ids),
                np.array([len(p) // 4 for p in packed], "<i8").tobytes(), starts.tobytes(), body,
            ]
            types = [pa.int64()] * 4 + [pa.binary()] * 5
            names = [c.split()[0] for c in FORMAT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = [x.as_py().decode("utf-8", "replace") for x in part.column(1)]
                for i, p in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    if shard is None:
                        shard = LEAST if i is None else i
                    ids.append(i)
                    packed.append(p + end)
                    held += len(p) // 4 + 1
                    if held >= SEGMENT_IDS:
                        yield flush()
                        seg, before, held = seg + 1, before + held, 0
                        ids, packed = [], []
        if ids:
            yield flush()
        C.trim()

    order = F.coalesce("doc_id", F.lit(LEAST))
    (
        C.id_and_bytes(docs, id_col, text_col)
        .repartitionByRange(order)
        .sortWithinPartitions(order, F.xxhash64("text"), "text")
        .mapInArrow(run, FORMAT)
        .write.parquet(out)
    )


def _documents(spark: SparkSession, path: str, last: tuple[str, str], kind: pa.DataType, take) -> DataFrame:
    """``doc_id, start, n_tokens`` and ``take(packed ids)`` of each document of a token file."""
    C.ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                body = row["body"]
                ids = np.concatenate([unpack_block(body, s) for s in np.frombuffer(row["block_starts"], "<u4").tolist()])
                sizes = np.frombuffer(row["doc_sizes"], "<i8")
                ends = np.cumsum(sizes)
                docs = np.frombuffer(row["doc_ids"], "<i8").tolist()
                for low in range(0, len(docs), 4096):
                    e, z = ends[low : low + 4096], sizes[low : low + 4096]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if n else i for i, n in zip(docs[low : low + 4096], row["doc_null"][low : low + 4096], strict=True)], pa.int64()),
                            pa.array(row["start"] + e - z, pa.int64()),
                            pa.array(z, pa.int64()),
                            pa.array([take(ids[b - m : b].tobytes()) for b, m in zip(e.tolist(), z.tolist(), strict=True)], kind),
                        ],
                        ["doc_id", "start", "n_tokens", last[0]],
                    )
        C.trim()

    segments = spark.read.schema(FORMAT).parquet(path)
    # One row per shard, that is, per write task: small whatever the corpus, so it may be broadcast and put in one order.
    shards = segments.groupBy("shard").agg(F.max(F.col("before") + F.col("n_tokens")).alias("size"))
    rising = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("size").over(rising), F.lit(0)).alias("base"))
    return (
        segments.join(F.broadcast(shards), "shard")
        .select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "doc_null", "doc_sizes", "block_starts", "body")
        .mapInArrow(run, f"doc_id long, start long, n_tokens long, {last[0]} {last[1]}")
    )


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` (packed little-endian uint32) of each document of a token file."""
    return _documents(spark, path, ("ids", "binary"), pa.binary(), bytes)


def digest_token_file(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document of a token file."""
    return _documents(spark, path, ("ids_crc32", "long"), pa.int64(), zlib.crc32)
