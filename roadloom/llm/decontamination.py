"""Benchmark decontamination by latent semantic retrieval.

Documents are read as passages of 64 words that start every 32 words. Three passes over the corpus, none of
which shuffles texts: document frequencies of the benchmark's words; the sketch of a randomised SVD of the
TF-IDF matrix of all corpus passages with the benchmark's own passages stacked below (partial sums of a
vocabulary x rank matrix, added up in Spark), from which the driver computes singular values and vectors and
keeps the leading ``RANK``, half as many as a block has passages; and the search, which projects every
passage into the latent space, keeps the benchmark items whose covered share is high enough, and confirms
them on the words themselves by longest common subsequence and by a check of the item's answer. Only words
that occur in the benchmark matter for a cosine with one of its items, so the vocabulary is the benchmark's.
Items longer than a passage are retrieved by each of their own passages of at most 64 words; the words they
are confirmed on reach as far to both sides as the whole item does, and half a passage more.
The benchmark is taken in blocks of ``BLOCK`` passages, which bounds a block's tables (a vocabulary of at most
64 words a passage, times the rank); as many blocks share a pass as ``PASS_BYTES`` hold.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import split_words, tidy

HALF, BLOCK, OVERSAMPLE, SEED = 32, 256, 16, 5
#: Singular vectors kept at most, for blocks of BLOCK passages, and bytes of the tables that one pass broadcasts.
RANK, PASS_BYTES = 128, 48 << 20
#: Words whose partial sums travel together, and tasks whose sums are added first.
CHUNK, FAN = 64, 64
#: Words in more than this share of documents are left out where an item has others enough.
COMMON, FEW = 0.1, 4
#: A candidate's least cosine (below it, the item must stand close together) and covered share; what LCS and answer must reach.
MIN_COSINE, MIN_COVER, MIN_LCS, MIN_ANSWER, SHORT = 0.3, 0.35, 0.7, 0.5, 8
BENCH_WEIGHT = 30.0
_MARKS = ".,;:!?\"'()[]{}#*$%&|<>"


def normal(word: str) -> str:
    return word.lower().strip(_MARKS)


def item_words(text: str) -> list[str]:
    return [w for w in (normal(x) for x in re.findall(r"[^\x20\x09-\x0D]+", text)) if w]


def answer_words(text: str) -> list[str]:
    """The words of an item's last sentence, or its last quarter if that is longer."""
    every = item_words(text)
    last = item_words(re.split(r"[.!?\n]+\s*", text.strip(" .!?\n"))[-1])
    return every[-max(len(last), len(every) // 4, 1) :]


class Text:
    """Words of a batch of texts, each distinct one normalised once, and where half passages begin."""

    def __init__(self, texts: pa.Array):
        self.flat, self.offsets = split_words(texts)
        coded = self.flat.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), _MARKS)
        n = np.diff(self.offsets)
        self.first_half = np.concatenate(([0], np.cumsum(np.maximum(1, -(-n // HALF)))))


class Words:
    """Benchmark word ids of a batch of texts, laid out by half passage."""

    def __init__(self, text: Text, vocabulary: pa.Array):
        ids = pc.fill_null(pc.index_in(text.plain, value_set=vocabulary), -1).to_numpy().astype(np.int64) if len(text.plain) else np.zeros(0, np.int64)
        every = ids[text.codes]
        self.at = np.flatnonzero(every >= 0)
        self.ids = every[self.at]
        self.first_half = text.first_half
        self.doc = np.searchsorted(text.offsets, self.at, side="right") - 1
        self.half = self.first_half[self.doc] + (self.at - text.offsets[self.doc]) // HALF
        self.n_halves = int(self.first_half[-1])
        self.joined = np.ones(self.n_halves, bool)  # does half j + 1 belong to the same text
        self.joined[self.first_half[1:] - 1] = False

    def by_half(self, rows: np.ndarray) -> np.ndarray:
        """Sum over each half of the matrix rows of its words."""
        out = np.zeros((self.n_halves, rows.shape[1]), np.float32)
        if len(self.ids):
            starts = np.flatnonzero(np.concatenate(([True], np.diff(self.half) != 0)))
            out[self.half[starts]] = np.add.reduceat(rows[self.ids], starts, axis=0)
        return out

    def passages(self, halves: np.ndarray) -> np.ndarray:
        """Row j: half j plus the next one of the same text."""
        out = halves.copy()
        j = np.flatnonzero(self.joined)
        out[j] += halves[j + 1]
        return out


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[str, int] = {}
    for i, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & masks.get(w, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def near_copy(item: list[str], text: list[str], least: float) -> bool:
    """Is so large a share of the item within a stretch of words hardly longer than the item?"""
    step = max(1, len(item) // 4)
    return any(lcs(item, text[at : at + len(item) + step]) >= least * len(item) for at in range(0, len(text), step))


def item_passages(n: int) -> list[tuple[int, int]]:
    """Where an item of ``n`` words is cut into passages of at most 64 words, all about as long."""
    k = max(1, -(-n // (2 * HALF)))
    ends = [n * i // k for i in range(k + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def _small(texts: pa.RecordBatch, n: int = 250):
    for at in range(0, texts.num_rows, n):
        yield texts.slice(at, n)


class Block:
    """Benchmark items whose passages share a latent space."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [x for x in ((k, item_words(t), answer_words(t)) for k, t in items) if x[1]]
        self.every = sorted({w for _, ws, _ in self.items for w in ws})
        # what is retrieved: item, its first word and its words, one for each passage of an item
        self.passages = [(r, lo, ws[lo:hi]) for r, (_, ws, _) in enumerate(self.items) for lo, hi in item_passages(len(ws))]
        self.rank = min(RANK, len(self.passages), len(self.every))
        self.bytes = 4 * len(self.every) * (self.rank + OVERSAMPLE)

    def weigh(self, df: np.ndarray, n_docs: int) -> None:
        """Sets words and weights from document frequencies, and the random directions of the range finder."""
        place = {w: k for k, w in enumerate(self.every)}
        used = df <= COMMON * n_docs
        for _, _, ws in self.passages:
            if sum(used[place[w]] for w in set(ws)) < FEW:
                used[[place[w] for w in ws]] = True
        kept = np.flatnonzero(used)
        self.words = [self.every[k] for k in kept]
        self.idf = (np.log((n_docs + 1) / (df + 1)) + 0.05)[kept]
        place = {w: k for k, w in enumerate(self.words)}
        self.bench = np.zeros((len(self.passages), len(self.words)), np.float32)
        for r, (_, _, ws) in enumerate(self.passages):
            for w in ws:
                if w in place:
                    self.bench[r, place[w]] += self.idf[place[w]]
        sketch = min(len(self.words), self.rank + OVERSAMPLE)
        self.omega = np.linalg.qr(np.random.default_rng(SEED).standard_normal((len(self.words), sketch)))[0]

    def decompose(self, sums: np.ndarray) -> None:
        """Truncated SVD from ``A^T A omega`` of the corpus passages: the leading right singular vectors of all passages.

        The benchmark's passages are stacked below the corpus's. A sketch of the Gram matrix of a single view
        gives its eigenvalues, the squares of the singular values, and eigenvectors (randomised Nystrom).
        """
        sums = self.idf[:, None] * sums
        own = self.bench.T @ (self.bench @ self.omega)
        sketch = sums / (np.linalg.norm(sums) or 1.0) + BENCH_WEIGHT * own / (np.linalg.norm(own) or 1.0)
        shift = 1e-9 * (np.linalg.norm(sketch) or 1.0)
        sketch = sketch + shift * self.omega
        core = self.omega.T @ sketch
        low = np.linalg.cholesky((core + core.T) / 2 + shift * np.eye(len(core)))
        left, values, _ = np.linalg.svd(np.linalg.solve(low, sketch.T).T, full_matrices=False)
        self.singular = np.sqrt(np.maximum(values**2 - shift, 0))[: self.rank]
        basis = left[:, : self.rank].astype(np.float32)
        latent = self.bench @ basis
        self.norms = np.linalg.norm(latent, axis=1).astype(np.float32)
        self.latent = (latent / np.maximum(self.norms, 1e-9)[:, None]).astype(np.float32)
        self.rows = (self.idf[:, None] * basis).astype(np.float32)


def _pass(docs: DataFrame, blocks: list[Block]) -> DataFrame:
    """What the items of some blocks, whose tables together are within ``PASS_BYTES``, are found in: three scans for all of them."""
    spark = docs.sparkSession
    vocabularies = spark.sparkContext.broadcast([b.every for b in blocks])

    def frequencies(batches):
        known = [pa.array(v, pa.string()) for v in vocabularies.value]
        total, rows = [np.zeros(len(k), np.int64) for k in known], 0
        for batch in batches:
            for part in _small(batch):
                text = Text(part.column(1))
                rows += part.num_rows
                for k, t in zip(known, total, strict=True):
                    w = Words(text, k)
                    t += np.bincount(np.unique(w.doc * len(k) + w.ids) % len(k), minlength=len(k))
        out = [(b, at, n) for b, t in enumerate(total) for at, n in zip(np.flatnonzero(t).tolist(), t[t > 0].tolist(), strict=True)] + [(-1, 0, rows)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["block", "word", "n"])

    counted = {(r.block, r.word): r.n for r in docs.mapInArrow(tidy(frequencies), "block long, word long, n long").groupBy("block", "word").agg(F.sum("n").alias("n")).collect()}
    for b, block in enumerate(blocks):
        block.weigh(np.array([counted.get((b, k), 0) for k in range(len(block.every))], float), max(1, counted.get((-1, 0), 1)))
    shared = spark.sparkContext.broadcast([(b.words, (b.idf[:, None] * b.omega).astype(np.float32)) for b in blocks])

    def range_finder(batches):
        known = [(pa.array(names, pa.string()), rows, np.zeros(rows.shape, np.float64)) for names, rows in shared.value]
        for batch in batches:
            for part in _small(batch):
                text = Text(part.column(1))
                for names, rows, total in known:
                    w = Words(text, names)
                    y = w.passages(w.by_half(rows))
                    z = y.copy()  # each half counts in the passage that starts with it and in the one before
                    j = np.flatnonzero(w.joined)
                    z[j + 1] += y[j]
                    order = np.argsort(w.ids, kind="stable")
                    if len(order):
                        ids = w.ids[order]
                        starts = np.flatnonzero(np.concatenate(([True], np.diff(ids) != 0)))
                        total[ids[starts]] += np.add.reduceat(z[w.half[order]], starts, axis=0)
        task = TaskContext.get().partitionId()
        for b, (_, _, total) in enumerate(known):
            at = range(0, len(total), CHUNK)
            raw = [total[k : k + CHUNK].astype(np.float32).tobytes() for k in at]
            cols = [pa.array([b] * len(raw), pa.int64()), pa.array(at, pa.int64()), pa.array([task // FAN] * len(raw), pa.int64()), pa.array(raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["block", "word", "fan", "part"])

    def add_up(t: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, np.float32) for x in t.column("part").to_pylist()], axis=0, dtype=np.float64)
        return pa.table({"block": t.column("block").slice(0, 1), "word": t.column("word").slice(0, 1), "fan": pa.array([0], pa.int64()), "part": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    # at most FAN tasks' partial sums meet at a time, then one sum for each FAN tasks
    shape = "block long, word long, fan long, part binary"
    summed = docs.mapInArrow(tidy(range_finder), shape).groupBy("block", "word", "fan").applyInArrow(add_up, shape).groupBy("block", "word").applyInArrow(add_up, shape)
    sums = [np.zeros(b.omega.shape) for b in blocks]
    for r in summed.collect():
        part = np.frombuffer(bytes(r.part), np.float32).reshape(-1, sums[r.block].shape[1])
        sums[r.block][r.word : r.word + len(part)] = part
    for block, total in zip(blocks, sums, strict=True):
        block.decompose(total)
    ready = spark.sparkContext.broadcast([(b.words, b.rows, b.latent, b.norms, b.items, [x[:2] for x in b.passages]) for b in blocks])

    def search(batches):
        known = [(pa.array(names, pa.string()), *rest) for names, *rest in ready.value]
        for batch in batches:
            out: list[tuple] = []
            for part in _small(batch):
                text = Text(part.column(1))
                for names, rows, targets, sizes, items, parts in known:
                    out += [(part.column(0)[d].as_py(), *row) for d, row in found(text, Words(text, names), rows, targets, sizes, items, parts)]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "word_at"])

    return docs.mapInArrow(tidy(search), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id long, cosine double, lcs_share double, answer_share double, word_at long")


def found(text: Text, w: Words, rows: np.ndarray, targets: np.ndarray, sizes: np.ndarray, items: list, parts: list) -> list[tuple]:
    """Number of the text and item, cosine, shares and place for every item that a text of the batch holds."""
    z = w.passages(w.by_half(rows))
    dots = z @ targets.T
    cover = dots / np.maximum(sizes, 1e-9)
    p, q = np.nonzero(cover >= MIN_COVER)
    cosine = dots[p, q] / np.maximum(np.linalg.norm(z, axis=1)[p], 1e-9)
    doc = np.searchsorted(w.first_half, p, side="right") - 1
    best: dict[tuple[int, int], tuple] = {}
    shares: dict[tuple[int, int, int], tuple] = {}
    of = -1
    for i in np.lexsort((p, q, doc)).tolist():
        d, j = int(doc[i]), int(p[i] - w.first_half[doc[i]])
        if d != of:  # regions of one text at a time are remembered
            of = d
            shares.clear()
        k, first = parts[q[i]]
        lo, hi = int(text.offsets[d]), int(text.offsets[d + 1])
        number, item, answer = items[k]
        if len(item) <= 2 * HALF:
            a, b = (j - 1) * HALF, (j + 3) * HALF
        else:  # the passage may begin up to 64 words before or after its part of the item
            a, b = (j - 2) * HALF - first, (j + 3) * HALF - first + len(item)
        a, b = lo + max(0, a), min(hi, lo + b)
        if (k, a, b) not in shares:
            region = [normal(x) for x in text.flat.slice(a, b - a).to_pylist()]
            shares[k, a, b] = region, lcs(item, region) / len(item)
        region, share = shares[k, a, b]
        least = MIN_LCS if len(item) >= SHORT else 1.0
        if share < least:
            continue
        # other words of the passage lower the cosine, whatever the item's words are; few words may stand anywhere
        if (cosine[i] < MIN_COSINE or len(item) < SHORT) and not near_copy(item, region, least):
            continue
        held = len(set(answer).intersection(region)) / len(set(answer))
        if held < MIN_ANSWER:
            continue
        row = (number, float(cosine[i]), share, held, a - lo)
        if (d, k) not in best or (share, row[1]) > (best[d, k][2], best[d, k][1]):
            best[d, k] = row
    return [(d, row) for (d, _), row in best.items()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, lcs_share, answer_share, word_at)``: one row per document row and leaked item.

    ``word_at`` is the word at which the confirmed region begins. Null and empty texts and items match
    nothing; items of fewer than 8 words must occur word for word in order; equal items are reported each;
    repeated rows of documents give their rows again; null ids are kept; very long texts and items are taken
    whole. Without items or documents the result is empty. Columns other than the four named are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string")).where(F.col(item_text_col).isNotNull()).orderBy(item_col, item_text_col)
    blocks: list[Block] = []
    block: list[tuple[int, str]] = []
    parts = 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        parts += len(item_passages(len(item_words(row[1]))))
        if parts >= BLOCK:
            blocks.append(Block(block))
            block, parts = [], 0
    blocks = [b for b in [*blocks, Block(block)] if b.items]
    if not blocks:
        return slim.where("false").select("doc_id", *(F.lit(None).cast(t).alias(c) for c, t in (("item_id", "long"), ("cosine", "double"), ("lcs_share", "double"), ("answer_share", "double"), ("word_at", "long"))))
    passes: list[list[Block]] = [[]]
    for b in blocks:
        if passes[-1] and sum(x.bytes for x in passes[-1]) + b.bytes > PASS_BYTES:
            passes.append([])
        passes[-1].append(b)
    return reduce(DataFrame.unionByName, [_pass(slim, p) for p in passes])
