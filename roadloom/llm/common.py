"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadloom.session import cut

#: Words of every contract: runs of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]"
#: Materialised tables of at most so many rows of a few numbers are broadcast; larger ones are joined by a shuffle.
SMALL = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_text(col) -> F.Column:
    """Unsigned CRC-32 of a value written as text."""
    return F.crc32(col.cast("string").cast("binary"))


def parallel(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def words(text) -> F.Column:
    """Array of the words of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+", -1), "")


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a batch of texts end to end, and where each text's words start; null texts have none."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
    flat, offsets = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    # a text that starts or ends with white space gives empty words
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    return (flat, offsets) if full.all() else (flat.filter(pa.array(full)), np.concatenate(([0], np.cumsum(full)))[offsets])


_STEP = np.uint64(0x9E3779B97F4A7C15)


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values, from hashes of half as many."""

    def mixed(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))

    with np.errstate(over="ignore"):
        out, have, power, span = None, 0, h, 1
        while n:
            if n & 1:
                if out is None:
                    out, have = power, span
                else:
                    m = min(len(out), len(power) - have)
                    out, have = mixed(out[:m] * _STEP + power[have : have + m]), have + span
            n >>= 1
            if n:
                power = mixed(power[:-span] * _STEP + power[span:] + np.uint64(span))
                span *= 2
    return out


def release() -> None:
    """Give freed memory of this worker back to the system; workers live on between stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run):
    """A batch function that releases memory when its partition ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def hinted(ids: DataFrame) -> DataFrame:
    """A materialised table of a few numbers a row, broadcast where it has at most ``SMALL`` rows."""
    ids = cut(ids)
    return F.broadcast(ids) if ids.limit(SMALL + 1).count() <= SMALL else ids


def whole_groups(batches, keys: list[str], least: int = 50_000):
    """Tables of whole groups, of ``least`` rows or more, from batches sorted by ``keys``; a group may span batches."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < least:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        edges = group_edges(t, keys)
        if len(edges) > 2:
            yield t.slice(0, int(edges[-2]))
            t = t.slice(int(edges[-2]))
        held, rows = t.to_batches(), t.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_edges(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin in a sorted table, and its end."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for k in keys:
        new |= np.diff(t.column(k).to_numpy()) != 0
    return np.concatenate(([0], np.flatnonzero(new) + 1, [t.num_rows])) if t.num_rows else np.zeros(1, np.int64)
