"""Best-two-fit packing of documents into sequences of a fixed number of tokens.

Bins are filled one by one: the longest piece that fits goes in until none does; then the smallest piece of the bin
makes room for the two unpacked pieces that fill the room best, if they fill it better. Lengths are whole numbers up to
the capacity, so what the rule decides depends on a table of counts by length alone, and a bin that was decided once is
repeated for as long as the rule would decide it again. The table has as many rows as the capacity at most whatever the
corpus. Spark encodes the texts, counts the lengths, ranks the pieces of one length and puts each in its place.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C
from .token_file import encoder

#: Rows of ``length, task`` up to which their table is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"
#: Bits for the rank of a piece among those of its length.
RANK_BITS = 42


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Kinds of bins in the order in which they are filled: how many of it, and ``(length, times)`` of its pieces.

    The same as filling bins one at a time; a kind is repeated until one of the lengths that decided it runs short.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    lengths = sorted(left)
    if lengths and not 0 < lengths[0] <= lengths[-1] <= capacity:
        raise ValueError("lengths must be from 1 to the capacity")
    out = []
    while lengths:
        bin_, room, below = {}, capacity, capacity
        while k := bisect_right(lengths, min(room, below)):
            n = lengths[k - 1]
            bin_[n] = min(left[n], room // n)
            room -= bin_[n] * n
            below = n - 1
        need = dict(bin_)  # what must be there for the same decision
        if room and sum(bin_.values()) > 1:
            least = min(bin_)
            free = [n for n in lengths[: bisect_right(lengths, room + least - lengths[0])] if left[n] > bin_.get(n, 0)]
            pair = _best_pair(np.array(free, dtype=np.int64), np.array([left[n] - bin_.get(n, 0) for n in free]), room + least)
            if pair and sum(pair) > least:
                for n in pair:
                    need[n] = need.get(n, 0) + 1
                    bin_[n] = bin_.get(n, 0) + 1
                bin_[least] -= 1
        bins = min(1 + (left[n] - need[n]) // t if t else left[n] for n, t in bin_.items())
        out.append((bins, sorted(((n, t) for n, t in bin_.items() if t), reverse=True)))
        for n, t in bin_.items():
            left[n] -= bins * t
        if any(not left[n] for n in bin_):
            lengths = [n for n in lengths if left[n]]
    return out


def _best_pair(lengths: np.ndarray, counts: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two lengths of greatest sum within ``room``; of equal sums the one with the longest piece."""
    if not len(lengths):
        return None
    partner = np.minimum(np.searchsorted(lengths, room - lengths, "right") - 1, np.arange(len(lengths)))
    partner -= (partner == np.arange(len(lengths))) & (counts < 2)
    sums = np.where(partner >= 0, lengths + lengths[partner], -1)
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    return (int(lengths[best]), int(lengths[partner[best]])) if sums[best] >= 0 else None


def _slots(kinds: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a length go, by rank: sorted keys of length and first rank, and ``rank, times, sequence, offset``."""
    taken: dict[int, int] = {}
    keys, rows, sequence = [], [], 0
    for bins, pieces in kinds:
        offset = 0
        for n, times in pieces:
            first = taken.get(n, 0)
            keys.append((n << RANK_BITS) + first)
            rows.append((first, times, sequence, offset))
            taken[n] = first + bins * times
            offset += n * times
        sequence += bins
    order = np.argsort(np.array(keys, dtype=np.int64))
    return np.array(keys, dtype=np.int64)[order], np.array(rows, dtype=np.int64).reshape(-1, 4)[order]


def cut_documents(docs: DataFrame, vocab_path: str, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    """The pieces of all documents, as a table: a piece is the ``nth`` of its length in the ``task`` that wrote it."""
    C.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, task = encoder(vocab_path), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64).tolist()
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                part = batch.slice(k, 128)
                texts = [x.as_py().decode("utf-8", "replace") for x in part.column(1)]
                rows: list[list] = [[] for _ in range(8)]
                for i, packed in zip(part.column(0).to_pylist(), enc.encode(texts), strict=True):
                    packed += end
                    whole, start, piece = len(packed) // 4, 0, 0
                    stop = (whole - 1) % capacity + 1
                    while start < whole:
                        n, body = stop - start, packed[4 * start : 4 * stop]
                        for column, v in zip(rows, (i, piece, start, n, zlib.crc32(body), task, seen[n], body if with_ids else None), strict=True):
                            column.append(v)
                        seen[n] += 1
                        start, stop, piece = stop, stop + capacity, piece + 1
                names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
                columns = [pa.array(v, t) for v, t in zip(rows, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns[: 7 + with_ids], names[: 7 + with_ids])
        C.trim()

    return C.materialize(C.id_and_bytes(docs, id_col, text_col).mapInArrow(run, PIECES + ", ids binary" * with_ids), "pieces")


def pack_documents(
    docs: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, if asked for, ``ids`` (packed uint32).

    A document is the ids of its whole text and ``end_id``; a null text counts as empty and is the end id alone. A
    document over the capacity is cut into pieces of the capacity, the first one shorter where need be. One row for
    each piece; a row without an id keeps its null, repeated rows are packed each for itself, further columns are
    ignored, an empty table gives no row. Which of several pieces of one length goes where depends on how Spark cuts
    the input into tasks; the number of sequences and their lengths do not.
    """
    spark = docs.sparkSession
    pieces = cut_documents(docs, vocab_path, capacity, end_id, with_ids, id_col, text_col)
    counts = C.materialize(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "piece-counts")
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n"))
    kinds = best_two_fit({r.length: r.n for r in by_length.collect()}, capacity)  # a row for each length up to the capacity
    keys, slots = _slots(kinds)
    # one row for each task and length
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = C.bounded(counts.select("length", "task", F.coalesce(before, F.lit(0)).alias("base")), "piece-bases", BROADCAST_ROWS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy()
            row = slots[np.searchsorted(keys, (n << RANK_BITS) + rank, "right") - 1]
            nth = rank - row[:, 0]
            kept = [c for c in batch.schema.names if c != "rank"]
            placed = [pa.array(row[:, 2] + nth // row[:, 1]), pa.array(row[:, 3] + nth % row[:, 1] * n)]
            yield pa.RecordBatch.from_arrays([batch.column(c) if c != "length" else pa.array(n) for c in kept] + placed, [*kept, "sequence_id", "offset"])

    more = ["ids"] if with_ids else []
    ranked = pieces.join(bases, ["length", "task"]).select("doc_id", "piece", "start", F.col("length"), "ids_crc32", *more, (F.col("base") + F.col("nth")).alias("rank"))
    kinds_ = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    C.ship(spark)
    return ranked.mapInArrow(place, kinds_)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids, doc_ids, offsets``: the sequences themselves from packed pieces with ids.

    A sequence has at most as many pieces as the capacity, so no group is larger than that.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    told = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    return told.select(
        "sequence_id", "n_tokens", F.expr("aggregate(parts, cast('' AS binary), (a, p) -> concat(a, p.ids))").alias("ids"),
        F.col("parts.doc_id").alias("doc_ids"), F.col("parts.offset").alias("offsets"),
    )
