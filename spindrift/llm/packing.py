"""Packing by power-of-two decomposition (operator 5).

A document of n ids is cut into pieces whose lengths are powers of two: as many
of ``seq_len`` as fit, then one for each set bit of the rest, longest first.
Each piece is a sequence of its own, so no sequence crosses documents and none
holds padding.  Pieces of equal length share a bucket (log2 of the length); the
bucket is the high part of the sequence id, so ids of one bucket lie together.

Nothing is shuffled: a document is cut where it is read.  Ids come from the
number of the partition and a running count, so they are unique, and a task run
again after a lost executor gives the same ids for the same input.

Defined results: null or empty text packs as its end id alone; repeated rows
and null ids are documents of their own; an empty table gives no rows; columns
beyond the two named are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .tokens import coder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, ids binary"
#: Bytes of texts that are encoded and given out together; a longer text is one by itself.
TOGETHER = 1_000_000
#: Bits of a sequence id: 5 of the bucket, 24 of the partition, 34 of the count.
PARTITION_BITS, COUNT_BITS = 24, 34


def cuts(n: int, seq_len: int) -> list[int]:
    """The lengths of the pieces of ``n`` ids, in order."""
    out = [seq_len] * (n // seq_len)
    rest = n % seq_len
    out += [1 << b for b in range(seq_len.bit_length() - 1, -1, -1) if rest >> b & 1]
    return out


def portions(batch: pa.RecordBatch, text: str = "_text", most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, so many that their texts have ``most`` bytes at most, or one row."""
    upto = np.cumsum(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(upto, (int(upto[at - 1]) if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def pack(docs: DataFrame, vocabulary: str, *, keeps_blanks: bool = True, end_id: int = 0, seq_len: int = 1024, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece; ``ids`` holds its ids as little-endian unsigned 32-bit integers (null without ``with_ids``)."""
    if seq_len < 1 or seq_len & (seq_len - 1):
        raise ValueError("seq_len must be a power of two")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.trim()
        c = coder(vocabulary, keeps_blanks)
        at = TaskContext.get().partitionId() << COUNT_BITS
        count = 0
        for batch in (p for b in batches for p in portions(b)):  # a whole batch's ids and pieces would be held at once
            names = batch.column("_id").to_pylist()
            flat, off = c.encode(batch.column("_text"))
            off = off.tolist()
            cols: list[list] = [[] for _ in range(9)]
            for name, first, last in zip(names, off, off[1:]):
                ids = flat[first:last].tobytes() + end
                n, start = len(ids) // 4, 0
                for k in cuts(n, seq_len):
                    piece = ids[4 * start : 4 * (start + k)]
                    bucket = k.bit_length() - 1
                    for col, v in zip(cols, (name, start, k, zlib.crc32(piece), n, bucket << (PARTITION_BITS + COUNT_BITS) | at | count, 0, bucket, piece if with_ids else None)):
                        col.append(v)
                    start, count = start + k, count + 1
            types = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, types)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return rows.mapInArrow(run, SCHEMA)
