"""Token ids in a range-coded binary file (operator 3).

Static rANS with a 64-bit state and 32-bit words.  One frequency table, counted
over all tokens and scaled to 2**20, serves every block of a file.  Blocks are
independent; within a block token i belongs to lane i mod L, and the L lanes
are coded side by side as vectors.  Every ``CHECK_STEPS`` steps the block keeps
a checkpoint (all lane states and the place in the words) and a crc32 of the
tokens up to the next one, so each stretch between checkpoints can be decoded
alone, in parallel, and is verified.

The file is a folder of two Parquet tables, written through Spark's committer so
a lost executor's attempt leaves nothing behind and any store will do:
``table`` (token, freq) and ``blocks`` (part, block, start, n, doc_ids, lens,
payload).  A payload is ``MAGIC, version, lanes, tokens, steps between
checkpoints, checkpoints`` as six unsigned 32-bit integers, then for each
checkpoint its word offset and crc32 (two 32-bit integers) and its lane states
(64-bit), then the words.

Documents are dealt out by ranges of their id and sorted there, so blocks in
order of (part, block) hold the documents in ascending order of id.

Defined results: null text is an empty one (only the end id); null ids come
first; rows repeated under one id are kept, in order of their text; an empty
table gives a file without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .tokens import coder

MAGIC, VERSION = 0x534E4152, 1
SCALE_BITS = 20
LOW = np.uint64(1 << 31)
MAX_LANES, CHECK_STEPS, BLOCK_TOKENS = 2048, 128, 1 << 19
DOCS_AT_ONCE = 4096
HEAD = 6

TOKENS = "part int, block int, rel_start long, n long, doc_ids array<long>, lens array<long>, ids binary"
BLOCKS = "part int, block int, start long, n long, doc_ids array<long>, lens array<long>, payload binary"
DOCS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def scaled(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that add up to 2**SCALE_BITS, for counts over 0 of distinct tokens."""
    size = 1 << SCALE_BITS
    if len(counts) > size:
        raise ValueError("more distinct tokens than the table's scale holds")
    freq = np.maximum(1, (counts.astype(np.float64) * (size / counts.sum())).astype(np.int64))
    over = int(freq.sum()) - size
    order = np.lexsort((tokens, -freq))
    for i in order if over > 0 else order[:1]:
        step = min(over, int(freq[i]) - 1)
        freq[i] -= step
        over -= step
        if not over:
            break
    return freq


class Table:
    """The frequency table as arrays for coding; ``tokens`` ascending."""

    def __init__(self, tokens: np.ndarray, freq: np.ndarray):
        top = int(tokens.max()) + 1 if len(tokens) else 1
        self.freq = np.zeros(top, np.uint64)
        self.cum = np.zeros(top, np.uint64)
        self.freq[tokens] = freq
        self.cum[tokens] = np.cumsum(freq) - freq
        self.slots = np.repeat(tokens.astype(np.uint32), freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """The payload of one block."""
    n = len(ids)
    lanes = int(min(MAX_LANES, max(1, n // 64)))
    steps = -(-n // lanes)
    state = np.full(lanes, LOW, np.uint64)
    shift, keep = np.uint64(63 - SCALE_BITS), np.uint64(0xFFFFFFFF)
    words: list[np.ndarray] = []
    marks: list[tuple[int, np.ndarray]] = []
    sent = 0
    for step in range(steps - 1, -1, -1):
        own = ids[step * lanes : (step + 1) * lanes]
        x, f, c = state[: len(own)], table.freq[own], table.cum[own]
        full = x >= f << shift
        out = x[full]
        words.append((out & keep).astype("<u4"))
        sent += len(out)
        x[full] = out >> np.uint64(32)
        q = x // f
        state[: len(own)] = (q << np.uint64(SCALE_BITS)) + (x - q * f) + c
        if step % CHECK_STEPS == 0:
            marks.append((sent, state.copy()))
    head = np.array([MAGIC, VERSION, lanes, n, CHECK_STEPS, len(marks)], "<u4").tobytes()
    body = []
    for k, (after, at) in enumerate(reversed(marks)):
        part = ids[k * CHECK_STEPS * lanes : (k + 1) * CHECK_STEPS * lanes].astype("<u4").tobytes()
        body += [np.array([sent - after, zlib.crc32(part)], "<u4").tobytes(), at.astype("<u8").tobytes()]
    return head + b"".join(body) + b"".join(w.tobytes() for w in reversed(words))


def checkpoints(payload: bytes) -> int:
    return int(np.frombuffer(payload, "<u4", HEAD)[5])


def decode(payload: bytes, table: Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """The tokens from checkpoint ``first`` up to checkpoint ``last`` (all without it), verified."""
    magic, version, lanes, n, every, marks = (int(v) for v in np.frombuffer(payload, "<u4", HEAD))
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a block of this format")
    width = 8 + 8 * lanes
    words = np.frombuffer(payload, "<u4", offset=4 * HEAD + marks * width)
    out, mask, shift = [], np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS)
    for k in range(first, marks if last is None else last):
        at = 4 * HEAD + k * width
        pos, crc = (int(v) for v in np.frombuffer(payload, "<u4", 2, at))
        state = np.frombuffer(payload, "<u8", lanes, at + 8).astype(np.uint64)
        stop = min(n, (k + 1) * every * lanes)
        got = np.empty(stop - k * every * lanes, np.uint32)
        for i in range(0, len(got), lanes):
            x = state[: min(lanes, len(got) - i)]
            slot = x & mask
            sym = table.slots[slot]
            got[i : i + len(x)] = sym
            x = table.freq[sym] * (x >> shift) + slot - table.cum[sym]
            low = np.flatnonzero(x < LOW)
            x[low] = (x[low] << np.uint64(32)) | words[pos : pos + len(low)]
            pos += len(low)
            state[: len(x)] = x
        if zlib.crc32(got.astype("<u4").tobytes()) != crc:
            raise ValueError("checksum of a block does not hold")
        out.append(got)
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[f[0] for f in fields])


def _tokenized(docs: DataFrame, vocabulary: str, keeps_blanks: bool, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Blocks of plain ids; a block ends with the document that fills it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part = coder(vocabulary, keeps_blanks), TaskContext.get().partitionId()
        kind = _width(c.size())
        end = np.array([end_id], kind)
        block, start, n, names, lens, parts = 0, 0, 0, [], [], []

        def closed():
            return _batch(TOKENS, [(part, block, start, n, names, lens, np.concatenate(parts).tobytes())])

        for batch in batches:
            ids_of = batch.column("_id").to_pylist()
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                flat, off = c.encode(batch.column("_text").slice(at, DOCS_AT_ONCE))
                off = off.tolist()
                for name, first, last in zip(ids_of[at : at + DOCS_AT_ONCE], off, off[1:]):
                    names.append(name)
                    lens.append(last - first + 1)
                    parts += [flat[first:last].astype(kind), end]
                    n += lens[-1]
                    if n >= BLOCK_TOKENS:
                        yield closed()
                        block, start, n, names, lens, parts = block + 1, start + n, 0, [], [], []
        if names:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, "_id").sortWithinPartitions("_id", "_text").mapInArrow(run, TOKENS)


def _width(vocab: int) -> str:
    return "<u2" if vocab <= 1 << 16 else "<u4"


def write(docs: DataFrame, vocabulary: str, path: str, *, keeps_blanks: bool = False, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encodes every text of ``docs``, appends ``end_id`` to each and writes the file at ``path``."""
    spark = docs.sparkSession
    kind = _width(coder(vocabulary, keeps_blanks).size())
    plain_at = common.scratch(spark, "rans-tokens")
    _tokenized(docs, vocabulary, keeps_blanks, end_id, id_col, text_col).write.option("compression", "zstd").parquet(plain_at)
    plain = spark.read.schema(TOKENS).parquet(plain_at)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                own = np.bincount(np.frombuffer(ids.as_buffer(), kind))
                if len(own) > len(total):
                    own, total = total, own
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["token", "n"])

    # no more rows than the vocabulary has tokens
    counts = plain.select("ids").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = sorted((r.token, r.n) for r in counts.collect())
    tokens = np.array([t for t, _ in found], np.int64)
    freq = scaled(tokens, np.array([n for _, n in found], np.int64)) if found else np.zeros(0, np.int64)
    # one row for each part, of which there are as many as shuffle partitions
    totals = plain.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for r in totals:
        base[r.part], at = at, at + r.n
    shared = spark.sparkContext.broadcast((tokens, freq, base))
    spark.createDataFrame([(int(t), int(f)) for t, f in zip(tokens, freq)], "token long, freq long").coalesce(1).write.parquet(f"{path}/table")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, freq, base = shared.value
        coding = Table(tokens, freq)
        for batch in batches:
            for i in range(batch.num_rows):
                r = {k: batch.column(k)[i] for k in batch.schema.names}
                ids = np.frombuffer(r["ids"].as_buffer(), kind)
                part = r["part"].as_py()
                yield _batch(BLOCKS, [(part, r["block"].as_py(), base[part] + r["rel_start"].as_py(), len(ids), r["doc_ids"].as_py(), r["lens"].as_py(), encode(ids, coding))])

    plain.mapInArrow(code, BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    common.remove(spark, plain_at)
    return path


def read_table(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The shared frequency table: at most 2**SCALE_BITS rows."""
    rows = sorted((r.token, r.freq) for r in spark.read.schema("token long, freq long").parquet(f"{path}/table").collect())
    return np.array([t for t, _ in rows], np.int64), np.array([f for _, f in rows], np.int64)


def read(spark: SparkSession, path: str, *, with_ids: bool = True) -> DataFrame:
    """Decodes the file in parallel: one row per document, with its ids as an array unless told otherwise."""
    shared = spark.sparkContext.broadcast(read_table(spark, path))
    schema = f"{DOCS}, ids array<long>" if with_ids else DOCS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coding = Table(*shared.value)
        for batch in batches:
            for i in range(batch.num_rows):
                names, lens = batch.column("doc_ids")[i].as_py(), batch.column("lens")[i].as_py()
                ids = decode(batch.column("payload")[i].as_buffer().to_pybytes(), coding).astype("<u4")
                at, rows = 0, []
                base = batch.column("start")[i].as_py()
                for name, n in zip(names, lens):
                    own = ids[at : at + n]
                    row = (name, base + at, n, zlib.crc32(own.tobytes()))
                    rows.append((*row, own.astype(np.int64)) if with_ids else row)
                    at += n
                yield _batch(schema, rows)

    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").select("start", "doc_ids", "lens", "payload").mapInArrow(run, schema)
