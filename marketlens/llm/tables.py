"""Small helpers shared by the corpus operators: reading, row sizes, Arrow text buffers, word hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at a time, so that its arrays stay small whatever the batch size.
SLICE_BYTES = 1 << 20
#: Rows that Spark hands to Python at a time.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: Bytes of text that are written as one compressed batch, and that the documents of one lane hold.
BATCH_BYTES, LANE_BYTES = 8 << 20, 4 << 20
#: Random odd multiplier and seed of the byte hashes.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: ASCII white space.
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Byte to byte, A-Z in lower case.
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def small_batches(spark: SparkSession) -> None:
    """Lets Spark hand rows to Python in batches that stay small with long texts, unless the session's are smaller yet.

    The session keeps the setting, as queries run after they are built.
    """
    if int(spark.conf.get(BATCH_KEY)) > BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def groups_for(rows: int, per_group: int) -> int:
    """How many groups keep the mean group at ``per_group`` rows or fewer."""
    return max(1, -(-rows // per_group))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit values."""
    out = values.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        out ^= out >> np.uint64(shift)
        out *= np.uint64(factor)
    out ^= out >> np.uint64(31)
    return out


BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


def release() -> None:
    """Gives memory that a Python worker has freed back to the machine, since workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, null as empty, and where each row starts; one more offset ends the last."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    column = pc.fill_null(column, "") if column.null_count else column
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``limit`` bytes of text, or of one row."""
    for batch in batches:
        ends = text_buffer(batch.column(column))[1][1:]
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])
    release()


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of bytes other than ASCII white space, in order, and the row it is in."""
    text = data if fold is None else fold[data]
    inner = ~SPACE[text]
    if not inner.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, last = inner.copy(), inner.copy()
    first[1:] &= ~inner[:-1]
    last[:-1] &= ~inner[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(text))]
    first[edges] = inner[edges]
    last[edges - 1] = inner[edges - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    heads = np.cumsum(lengths) - lengths
    powers = np.multiply.accumulate(np.full(int(lengths.max()), MULTIPLIER, np.uint64))
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(heads, lengths)
    terms = BYTE_CODES[text[inner]]
    terms *= powers[place]
    return mix(np.add.reduceat(terms, heads)), np.searchsorted(offsets, starts, "right") - 1


def by_group(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """One table per run of equal values in a column of integers; the rows must come sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(column).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
        for start, stop in zip(cuts, cuts[1:]):
            if held and values[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = values[start]
    if held:
        yield pa.Table.from_batches(held)
    del held
    release()


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and the row of each, in order.

    A row of fewer words has one run of all its words, a row without words none.
    """
    words, rows = word_hashes(data, offsets)
    if not len(words):
        return words, rows
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    total = np.zeros(len(words), np.uint64)
    for k in range(width):
        total[: len(words) - k] += words[k:] * factors[k]
    full = np.zeros(len(words), bool)
    if len(words) >= width:
        full[: len(words) - width + 1] = rows[: len(words) - width + 1] == rows[width - 1 :]
    firsts = np.flatnonzero(np.diff(rows, prepend=-1))
    for first in firsts[counts[rows[firsts]] < width]:
        size = counts[rows[first]]
        total[first] = (words[first : first + size] * factors[:size]).sum(dtype=np.uint64) + np.uint64(size)
        full[first] = True
    return mix(total[full]), rows[full]


def batches_of(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """The rows in tables of about ``limit`` bytes of text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, "text", limit):
        held.append(batch)
        size += int(text_buffer(batch.column("text"))[1][-1])
        if size >= limit:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def laned(docs: DataFrame) -> DataFrame:
    """(lane, rows): the rows of each batch and lane, as compressed Arrow streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for table in batches_of(batches, BATCH_BYTES):
            table = table.combine_chunks()
            lanes = table.column("_lane").to_numpy()
            out = []
            for lane in np.unique(lanes).tolist():
                part = table.take(pa.array(np.flatnonzero(lanes == lane)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_table(part)
                out.append((lane, sink.getvalue().to_pybytes()))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["lane", "rows"])

    return docs.mapInArrow(run, "lane int, rows binary")


def opened(left: pa.Table) -> pa.Table:
    release()
    return pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in left.column("rows")]).combine_chunks()
