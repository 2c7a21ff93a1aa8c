"""Removal of lines that many documents share, by probing minimal perfect hash arrays.

Distinct line keys are counted by a 128-bit hash. Those of two documents or more are dealt into shards; each
shard gets a minimal perfect hash (levels of bit arrays with ranks) that indexes three compact arrays: the
other half of the hash as fingerprint, the count and the document that keeps the line. Documents probe the
arrays, and the counts found there decide: no line is joined. While all arrays together are within
``BROADCAST_BYTES`` they are broadcast and every task probes its own texts. Beyond that the arrays stay where
they are and the hashes come to them: a batch of texts sends each distinct hash once to its shard, and gets
back the keepers of those that recur. Either way the same arrays are probed by the same code.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import tidy
from roadloom.session import cut, stored

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS, BROADCAST_BYTES, ENTRY_BYTES = 100_000, 64 << 20, 24
#: Texts that send their hashes together where the arrays are not broadcast.
BATCH = 1000
NO_ID = -(1 << 63)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = keys + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct unsigned 64-bit keys."""

    def __init__(self, keys: np.ndarray, gamma: float = 2.0):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        rest, done = keys, 0
        while len(rest):
            m = max(16, int(gamma * len(rest)))
            at = (_mix(rest, len(self.levels)) % np.uint64(m)).astype(np.int64)
            solo = np.bincount(at, minlength=m) == 1
            self.levels.append((m, solo, done))
            done += int(solo.sum())
            rest = rest[~solo[at]]
        self.size = done
        self._ranks()

    def _ranks(self) -> None:
        self.ranks = [np.cumsum(solo, dtype=np.int32) - 1 for _, solo, _ in self.levels]

    def __getstate__(self):
        return {"levels": [(m, np.packbits(solo), done) for m, solo, done in self.levels], "size": self.size}

    def __setstate__(self, state):
        self.levels = [(m, np.unpackbits(bits, count=m).astype(bool), done) for m, bits, done in state["levels"]]
        self.size = state["size"]
        self._ranks()

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key; -1 or an arbitrary one for keys that were not built in."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (m, solo, done) in enumerate(self.levels):
            at = (_mix(keys[open_], level) % np.uint64(m)).astype(np.int64)
            hit = solo[at]
            out[open_[hit]] = done + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        return out


def line_keys(texts: pa.Array, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of a batch, where each text's lines start, which lines have a long enough key, and those keys' hashes."""
    parts = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), "\n")
    lines, offsets = parts.flatten(), np.asarray(parts.offsets).astype(np.int64)
    keys = pc.ascii_lower(pc.ascii_trim_whitespace(lines))
    at = np.flatnonzero(np.asarray(pc.greater_equal(pc.utf8_length(keys), least)))
    one = xxhash.xxh3_128_digest
    raw = b"".join([one(x) for x in keys.take(pa.array(at)).cast(pa.binary()).to_pylist()])
    return lines, offsets, at, np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, 2)


def recurring(docs: DataFrame, least: int) -> DataFrame:
    """``(hi, lo, n, keeper)``: line keys that at least two documents hold; what stands in one document recurs nowhere."""

    def run(batches):
        for batch in batches:
            _, offsets, at, hashes = line_keys(batch.column(1), least)
            whose = batch.column(0).take(pa.array(np.searchsorted(offsets, at, side="right") - 1))
            yield pa.RecordBatch.from_arrays([whose, pa.array(hashes[:, 0].view(np.int64)), pa.array(hashes[:, 1].view(np.int64))], names=["doc_id", "hi", "lo"])

    keys = docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, hi long, lo long")
    each = keys.groupBy("hi", "lo", "doc_id").agg(F.lit(1).alias("one"))
    return each.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where("n >= 2")


def n_shards(n: int) -> int:
    return max(1, -(-n // SHARD_KEYS))


def shard_of(hi, shards: int) -> F.Column:
    return F.pmod(hi, F.lit(shards).cast("long"))


def build_shards(counted: DataFrame, n: int) -> DataFrame:
    """One row per shard that has keys: its number and the pickled perfect hash with its arrays."""

    def build(t: pa.Table) -> pa.Table:
        hi, lo = (t.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        first = np.unique(hi, return_index=True)[1]  # two keys with equal halves: the second goes to the spare list
        spare = np.setdiff1d(np.arange(len(hi)), first)
        h = PerfectHash(hi[first])
        to = h.index(hi[first])
        arrays = []
        for c, kind in ((lo, np.uint64), (t.column("n").to_numpy(), np.uint32), (t.column("keeper").to_numpy(), np.int64)):
            a = np.zeros(h.size, kind)
            a[to] = np.minimum(c[first], np.iinfo(np.uint32).max) if kind is np.uint32 else c[first]
            arrays.append(a)
        extra = {(int(hi[i]), int(lo[i])): (int(t.column("n")[int(i)].as_py()), int(t.column("keeper")[int(i)].as_py())) for i in spare}
        return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "blob": pa.array([pickle.dumps((h, *arrays, extra))], pa.binary())})

    return counted.withColumn("shard", shard_of("hi", n_shards(n))).groupBy("shard").applyInArrow(build, "shard long, blob binary")


def probe(shard: tuple, hashes: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """For each 128-bit hash of a shard: whether enough documents hold it by the count array, and the one that keeps it."""
    h, prints, counts, keepers, extra = shard
    found, keeper = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = h.index(hashes[:, 0])
    known = np.flatnonzero(at >= 0)
    at = at[known]
    right = prints[at] == hashes[known, 1]
    known, at = known[right], at[right]
    found[known], keeper[known] = counts[at] >= min_docs, keepers[at]
    for i in range(len(hashes)) if extra else ():
        if (x := extra.get((int(hashes[i, 0]), int(hashes[i, 1])))) is not None:
            found[i], keeper[i] = x[0] >= min_docs, x[1]
    return found, keeper


def _without(lines: pa.Array, offsets: np.ndarray, drop: np.ndarray, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Texts without the lines numbered in ``drop`` and how many each lost."""
    lost = np.bincount(np.searchsorted(offsets, drop, side="right") - 1, minlength=len(offsets) - 1)
    keep = np.ones(len(lines), bool)
    keep[drop] = False
    out = texts.to_pylist()
    for i in np.flatnonzero(lost).tolist():
        a, b = int(offsets[i]), int(offsets[i + 1])
        out[i] = "\n".join(lines.slice(a, b - a).filter(pa.array(keep[a:b])).to_pylist())
    return pa.array(out, pa.string()), lost


def drop_shared_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """All columns of ``docs`` with shared lines removed from its text, plus ``n_lines`` and ``n_dropped``.

    A null text becomes one empty line; very long texts are taken whole. Rows with the same id are one document,
    so repeated rows do not make a line recur; rows with a null id are one document with the least id. Ties: the
    largest id keeps its lines, all of them. Existing columns named ``n_lines`` or ``n_dropped`` are replaced.
    An empty table gives an empty result.
    """
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = cut(recurring(slim, min_chars))
    n = counted.count()
    rest = [c for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    packed = docs.select(F.struct(*rest).alias("_rest"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    shape = T.StructType([packed.schema["_rest"], T.StructField("_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    near = n * ENTRY_BYTES <= broadcast_bytes
    done = (_probed_at_home if near else _probed_at_shards)(packed, shape, counted, n, min_chars, min_docs)
    order = [F.col("_text").alias(c) if c == text_col else F.col(f"_rest.{c}") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return done.select(*order, "n_lines", "n_dropped")


def _cleaned(batch: pa.RecordBatch, min_chars: int, verdict) -> pa.RecordBatch:
    """The batch's texts without the lines that ``verdict`` finds to recur and to be kept elsewhere."""
    lines, offsets, at, hashes = line_keys(batch.column(2), min_chars)
    found, keeper = verdict(hashes)
    ids = batch.column(1).to_numpy()[np.searchsorted(offsets, at, side="right") - 1]
    text, lost = _without(lines, offsets, at[found & (keeper != ids)], batch.column(2))
    return pa.RecordBatch.from_arrays([batch.column(0), text, pa.array(np.diff(offsets)), pa.array(lost)], names=["_rest", "_text", "n_lines", "n_dropped"])


def _probed_at_home(packed: DataFrame, shape: T.StructType, counted: DataFrame, n: int, min_chars: int, min_docs: int) -> DataFrame:
    """Every task probes the broadcast arrays; their size was checked."""
    shared = packed.sparkSession.sparkContext.broadcast({r.shard: bytes(r.blob) for r in build_shards(counted, n).collect()})
    shards = n_shards(n)

    def run(batches):
        known = {k: pickle.loads(x) for k, x in shared.value.items()}

        def verdict(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, keeper = np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
            home = np.mod(hashes[:, 0].view(np.int64), shards)
            for k, shard in known.items():
                own = np.flatnonzero(home == k)
                found[own], keeper[own] = probe(shard, hashes[own], min_docs)
            return found, keeper

        for batch in batches:
            yield _cleaned(batch, min_chars, verdict)

    return packed.mapInArrow(tidy(run), shape)


def _probed_at_shards(packed: DataFrame, shape: T.StructType, counted: DataFrame, n: int, min_chars: int, min_docs: int) -> DataFrame:
    """Batches of texts send each distinct hash once to the shard's arrays and get the keepers of those that recur."""
    names = ["_rest", "_id", "_text"]

    def bundle(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                sink = pa.BufferOutputStream()
                part = batch.slice(at, BATCH)
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([(task << 33) + k]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["batch", "blob"])
                k += 1

    # written once, so that a batch keeps its number
    bundles = stored(packed.select(*names).mapInArrow(tidy(bundle), "batch long, blob binary"))

    def opened(blob: bytes) -> pa.RecordBatch:
        with pa.ipc.open_stream(blob) as r:
            return r.read_next_batch()

    def spread(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                hashes = line_keys(opened(batch.column(1)[k].as_py()).column(2), min_chars)[3]
                hashes = np.unique(hashes, axis=0).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hashes), batch.column(0)[k].as_py())), pa.array(hashes[:, 0].copy()), pa.array(hashes[:, 1].copy())], names=["batch", "hi", "lo"])

    asked = bundles.mapInArrow(tidy(spread), "batch long, hi long, lo long").withColumn("shard", shard_of("hi", n_shards(n)))

    def answer(t: pa.Table, arrays: pa.Table) -> pa.Table:
        hashes = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo")], axis=1) if t.num_rows else np.zeros((0, 2), np.uint64)
        found, keeper = probe(pickle.loads(arrays.column("blob")[0].as_py()), hashes, min_docs) if arrays.num_rows else (np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64))
        hit = np.flatnonzero(found)
        return t.select(["batch", "hi", "lo"]).take(pa.array(hit)).append_column("keeper", pa.array(keeper[hit]))

    met = asked.groupBy("shard").cogroup(build_shards(counted, n).groupBy("shard")).applyInArrow(answer, "batch long, hi long, lo long, keeper long")
    answers = met.groupBy("batch").agg(F.collect_list(F.struct("hi", "lo", "keeper")).alias("known"))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                known = batch.column(1).slice(k, 1).flatten()
                place = {(a, b): c for a, b, c in zip(*(known.field(c).to_pylist() for c in range(3)), strict=True)}

                def verdict(hashes: np.ndarray, place=place) -> tuple[np.ndarray, np.ndarray]:
                    got = [place.get((a, b)) for a, b in hashes.view(np.int64).tolist()]
                    return np.array([x is not None for x in got], bool), np.array([x or 0 for x in got], np.int64)

                yield _cleaned(opened(batch.column(0)[k].as_py()), min_chars, verdict)

    return bundles.join(answers, "batch", "left").select("blob", "known").mapInArrow(tidy(run), shape)
