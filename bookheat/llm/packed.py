"""Rows packed into chunks of bounded text, so that a text is shuffled compressed and found again by its chunk.

A chunk is one row: ``chunk``, its number, and ``blob``, an Arrow stream (zstd) of the rows in it. Numbers are
fixed once the chunks are staged; tasks that read a chunk again see the same rows in the same order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bookheat.llm.common import chunks, other_columns, row_of
from bookheat.session import stage

#: Text in a chunk, in bytes, unless a single text is longer.
CHUNK_BYTES = 2_000_000


def pack(docs: DataFrame, text: str, most: int = CHUNK_BYTES) -> DataFrame:
    """Staged ``chunk``, ``blob`` of ``docs``; see ``unpack``."""
    row = row_of(other_columns(docs, text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for b in chunks(batches, "text", most):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, b.schema, options=options) as w:
                w.write_batch(b)
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], ["blob"])

    rows = docs.select(row.alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return stage(rows.mapInArrow(run, "blob binary").select(F.monotonically_increasing_id().alias("chunk"), "blob"), "packed")


def unpack(blob: bytes) -> pa.RecordBatch:
    """``row`` and ``text`` of a chunk."""
    with pa.ipc.open_stream(blob) as r:
        return r.read_next_batch()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column of texts (or byte strings), end to end, and where each text ends, after a 0."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8), ends - ends[:1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]], ends - ends[0]
