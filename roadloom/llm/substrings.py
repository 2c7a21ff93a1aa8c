"""Removal of repeated passages with Aho-Corasick automata of recurring phrases.

Every window of ``window`` words has a seed: the phrase of ``SEED_WORDS`` words in it with the least hash.
Equal windows have equal seeds, so only windows whose seed recurs can repeat.

1. Seeds of all documents are counted by a shuffle of hashes; those that occur twice are confirmed.
2. Confirmed seeds return to the documents whose windows have them. Automata are sharded by batches of
   documents: each batch compiles the phrases that were confirmed for its own documents and streams all its
   documents past the automaton, which locates every occurrence, word for word. So an automaton is bounded
   by its batch whatever the corpus, and the corpus is streamed once, not once for each shard of all phrases.
3. Windows with a located seed are compared by hash over the corpus. A batch sends each distinct window
   once, so a passage that a third of all documents share costs a row per batch, not per document. In one
   sorted stream the first row of a window is its earliest occurrence; later ones are removed.
4. Removals return to their documents as runs.

Texts are shuffled twice, compressed, to meet their seeds and their removals; no group is gathered in memory.
"""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadloom.llm.common import rolled, split_words, tidy

WINDOW, SEED_WORDS = 20, 8
#: Texts that share an automaton.
SHARD_DOCS = 2000
NO_ID = -(1 << 63)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every ``n`` consecutive values."""
    span = 1
    while span * 2 <= n:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = n - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Batch:
    """Words, seeds and windows of a batch of texts, laid end to end."""

    def __init__(self, texts: pa.Array, window: int):
        flat, offsets = split_words(texts)
        self.offsets = offsets
        coded = flat.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        one = xxhash.xxh3_64_intdigest
        self.hashes = np.array([one(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)[self.codes] if len(flat) else np.zeros(0, np.uint64)
        self.window = window
        n = np.diff(offsets)
        whole = np.maximum(0, n - window + 1)
        #: of every window: its text, its place in the batch and its first word's number in the text
        self.doc = np.repeat(np.arange(len(n)), whole)
        self.start = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        self.at = offsets[self.doc] + self.start
        if len(self.at):
            self.phrases = rolled(self.hashes, SEED_WORDS)
            self.seed = _least(self.phrases, window - SEED_WORDS + 1)[self.at]
        else:
            self.phrases, self.seed = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def window_hashes(self, which: np.ndarray) -> np.ndarray:
        return rolled(self.hashes, self.window)[self.at[which]]

    def _phrases_of(self, lo: int, hi: int, known: np.ndarray) -> np.ndarray:
        """A place in texts ``lo`` to ``hi`` of each of their own seeds that is known: what an automaton is compiled from."""
        windows = np.flatnonzero((self.doc >= lo) & (self.doc < hi)) if hi - lo < len(self.offsets) - 1 else np.arange(len(self.doc))
        seeds, first = np.unique(self.seed[windows], return_index=True)
        first = windows[first[np.isin(seeds, known, assume_unique=True)]]
        inside = self.at[first][:, None] + np.arange(self.window - SEED_WORDS + 1)
        return inside[np.arange(len(first)), np.argmax(self.phrases[inside] == self.seed[first][:, None], axis=1)]

    def _stream(self, lo: int, hi: int, known: np.ndarray, hit: np.ndarray) -> None:
        """Marks in ``hit`` every place in texts ``lo`` to ``hi`` at which their automaton finds a phrase."""
        bounds = self.offsets[lo : hi + 1]
        a, b = int(bounds[0]), int(bounds[-1])
        place = self._phrases_of(lo, hi, known)
        if not len(place):
            return
        # a word is a few letters of 64 each, each place in it with an alphabet of its own: nodes stay narrow and matches aligned
        names, codes = np.unique(self.codes[a:b], return_inverse=True)
        many = max(1, -(-int(len(names) - 1).bit_length() // 6))
        letters = np.empty((b - a, many), np.uint32)
        for k in range(many):
            letters[:, k] = 0x100 + 64 * k + (codes >> 6 * k & 63).astype(np.uint32)
        text = letters.astype("<u4").tobytes()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        size, word = 4 * many, many * SEED_WORDS
        for p in (place - a).tolist():
            automaton.add_word(text[p * size : (p + SEED_WORDS) * size].decode("utf-32-le"), 1)
        automaton.make_automaton()
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if y - x >= self.window:
                ends = [e for e, _ in automaton.iter(text[(x - a) * size : (y - a) * size].decode("utf-32-le"))]
                if ends:
                    hit[(np.array(ends) - word + 1) // many + x] = True

    def located(self, known: np.ndarray) -> np.ndarray:
        """Windows whose seed is one of ``known`` (hashes), found by an automaton of those phrases' words."""
        if not len(self.at) or not len(known):
            return np.zeros(0, np.int64)
        hit = np.zeros(len(self.phrases), bool)
        for lo in range(0, len(self.offsets) - 1, SHARD_DOCS):
            self._stream(lo, min(lo + SHARD_DOCS, len(self.offsets) - 1), known, hit)
        least = _least(np.where(hit, self.phrases, np.uint64((1 << 64) - 1)), self.window - SEED_WORDS + 1)
        return np.flatnonzero(least[self.at] == self.seed)


def _squeezed(df: DataFrame) -> DataFrame:
    """``df`` with its last column, a text, compressed by zstandard: what is shuffled is about two thirds of what Spark writes."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            small = [squeeze(x) for x in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(small, pa.binary())], names=batch.schema.names)

    return df.mapInArrow(tidy(run), T.StructType([*df.schema.fields[:-1], T.StructField(df.columns[-1], T.BinaryType())]))


def _restored(column: pa.Array) -> list[bytes]:
    back = zstandard.ZstdDecompressor().decompress
    return [back(x) for x in column.to_pylist()]


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of consecutive starts of one text begin in sorted arrays, and their lengths."""
    begin = np.flatnonzero(np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(start) != 1)))) if len(doc) else np.zeros(0, np.int64)
    return begin, np.diff(np.append(begin, len(doc)))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _recurring_seeds(slim: DataFrame, window: int) -> DataFrame:
    """``(doc, seeds)``: of every document the seeds that occur at least twice in the corpus."""

    def spread(batches):
        for batch in batches:
            b = Batch(batch.column(2), window)
            doc = batch.column(0).to_numpy()
            change = np.concatenate(([True], (np.diff(b.seed) != 0) | (np.diff(b.doc) != 0))) if len(b.seed) else np.zeros(0, bool)
            d, s = b.doc[change], b.seed[change]
            order = np.lexsort((d, s))
            d, s = d[order], s[order]
            # a seed that recurs inside the batch is confirmed at once for all of its documents there
            new = np.concatenate(([True], np.diff(s) != 0)) if len(s) else np.zeros(0, bool)
            # counted over all phrases of the batch, so that repeats inside one document count as well
            every = np.sort(b.phrases)
            many = np.searchsorted(every, s, side="right") - np.searchsorted(every, s) > 1
            keep = new | np.concatenate(([True], np.diff(d) != 0)) if len(s) else new
            kind = np.where(new, np.where(many, 1, 0), 2)[keep]
            d, s = d[keep], s[keep]
            key = np.where(kind == 2, doc[d] * 31 + 7, s.view(np.int64)) & 0x7FFF
            back = np.argsort(doc[d], kind="stable")  # neighbours of one document compress well
            key, s, d, kind = key[back], s[back], d[back], kind[back]
            yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int16)), _signed(s), pa.array(doc[d]), pa.array(kind.astype(np.int8))], names=["key", "seed", "doc", "kind"])

    def confirm(batches):
        held: pa.RecordBatch | None = None  # the last row, which the next batch may confirm
        sent = False
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            s, kind = t.column("seed").to_numpy(), t.column("kind").to_numpy()
            same = np.concatenate(([False], np.diff(s) == 0))
            good = (kind > 0) | same | np.concatenate((same[1:], [False]))
            if held is not None and sent:
                good[0] = False
            sent = bool(good[-1])
            out = t.filter(pa.array(good)).select(["doc", "seed"])
            held = t.slice(t.num_rows - 1).to_batches()[0]
            yield from out.to_batches()

    rows = slim.mapInArrow(tidy(spread), "key short, seed long, doc long, kind byte")
    found = rows.repartition("key").sortWithinPartitions("seed").select("seed", "doc", "kind").mapInArrow(tidy(confirm), "doc long, seed long")
    return found.groupBy("doc").agg(F.collect_set("seed").alias("seeds"))


def _removals(slim: DataFrame, seeds: DataFrame, window: int) -> DataFrame:
    """``(doc, tag, runs)``: of every document the runs of windows that occur earlier."""

    def locate(batches):
        for batch in batches:
            doc, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            b = Batch(pa.array(_restored(batch.column(2)), pa.binary()).cast(pa.string()), window)
            known = np.unique(batch.column(3).flatten().to_numpy().view(np.uint64))
            which = b.located(known)
            w, seed = b.window_hashes(which) if len(which) else np.zeros(0, np.uint64), b.seed[which]
            row, start = b.doc[which], b.start[which]
            order = np.lexsort((start, doc[row], w))
            ow, od, os_ = w[order], doc[row[order]], start[order]
            new = np.concatenate(([True], np.diff(ow) != 0)) if len(order) else np.zeros(0, bool)
            lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
            later = (od > od[lead]) | ((od == od[lead]) & (os_ > os_[lead]))
            first = order[~later & new]
            # rows equal to the first in document and place but of another text keep their own row
            twin = order[~later & ~new]
            send = np.concatenate((first, twin))
            gone = np.sort(order[later])
            begin, length = _runs(row[gone], start[gone])
            g = gone[begin]
            part = np.concatenate((seed[send].astype(np.int64) & 0x7FFF, (doc[row[g]] * 31 + 7) & 0x7FFF))
            both = np.concatenate((send, g))
            back = np.lexsort((start[both], doc[row[both]]))  # runs of one document compress well
            both, part = both[back], part[back]
            cols = [
                pa.array(part.astype(np.int16)),
                _signed(np.concatenate((w[send], np.zeros(len(g), np.uint64)))[back]),
                pa.array(doc[row[both]]),
                pa.array(start[both].astype(np.int32)),
                pa.array(tag[row[both]]),
                pa.array(np.concatenate((np.zeros(len(send), np.int32), length.astype(np.int32)))[back]),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "w", "doc", "start", "tag", "n"])

    def decide(batches):
        last: tuple | None = None  # window, document and place of the earliest occurrence in progress
        for batch in batches:
            w, doc, start, tag, n = (batch.column(k).to_numpy() for k in range(5))
            ready = n > 0
            at = np.flatnonzero(~ready)
            later = np.zeros(len(at), bool)
            if len(at):
                ow, od, os_ = w[at], doc[at], start[at]
                new = np.concatenate(([True], np.diff(ow) != 0))
                lead = np.flatnonzero(new)[np.cumsum(new) - 1]
                ld, ls = od[lead], os_[lead]
                if last is not None and ow[0] == last[0]:
                    run = lead == 0
                    ld, ls = np.where(run, last[1], ld), np.where(run, last[2], ls)
                later = (od > ld) | ((od == ld) & (os_ > ls))
                last = (ow[-1], ld[-1], ls[-1])
            gone = at[later]
            gone = gone[np.lexsort((start[gone], tag[gone], doc[gone]))]
            begin, length = _runs(doc[gone], start[gone])
            rows = np.concatenate((np.flatnonzero(ready), gone[begin]))
            sizes = np.concatenate((n[ready], length.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array(doc[rows]), pa.array(tag[rows]), pa.array(start[rows]), pa.array(sizes.astype(np.int32))], names=["doc", "tag", "start", "n"])

    met = _squeezed(slim).join(seeds, "doc").select("doc", "tag", "text", "seeds")
    rows = met.mapInArrow(tidy(locate), "part short, w long, doc long, start int, tag short, n int")
    dealt = rows.repartition("part").sortWithinPartitions("w", "doc", "start").select("w", "doc", "start", "tag", "n")
    gone = dealt.mapInArrow(tidy(decide), "doc long, tag short, start int, n int")
    return gone.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def drop_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """All columns of ``docs`` with repeated words removed from its text, plus ``n_words`` and ``n_removed``.

    A word goes if a window of ``window`` words that covers it also starts earlier: in a document of smaller
    id, or earlier in the same one. Kept words are joined by one space. Null and empty texts become empty
    texts of no words; very long texts are taken whole. Rows that repeat an id and a text are one document (no
    copy removes the other); a null id is smaller than any other. Columns named ``n_words`` or ``n_removed`` are replaced. An empty
    table gives an empty result.
    """
    if window < SEED_WORDS:
        raise ValueError(f"windows need at least {SEED_WORDS} words")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    # tells rows apart that share an id but not a text
    tag = F.pmod(F.hash(text), F.lit(1 << 15)).cast("short").alias("tag")
    slim = docs.select(ident.alias("doc"), tag, text.alias("text"))
    removals = _removals(slim, _recurring_seeds(slim, window), window)
    rest = [c for c in docs.columns if c not in (text_col, "n_words", "n_removed")]
    packed = docs.select(F.struct(*rest).alias("_rest"), ident.alias("doc"), tag, text.alias("text"))
    met = _squeezed(packed).join(removals, ["doc", "tag"], "left").select("_rest", "text", "runs")
    shape = T.StructType([packed.schema["_rest"], T.StructField("_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def rebuild(batches):
        for batch in batches:
            texts, words, lost = [], [], []
            runs = batch.column(2)
            sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy()
            flat = runs.flatten()
            start, n = (flat.field(k).to_numpy() for k in range(2))
            at = 0
            for raw, k in zip(_restored(batch.column(1)), sizes.tolist(), strict=True):
                own = raw.split()
                words.append(len(own))
                if k:
                    cover = np.zeros(len(own) + 1, np.int32)
                    np.add.at(cover, start[at : at + k], 1)
                    np.add.at(cover, start[at : at + k] + n[at : at + k] + window - 1, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    at += k
                    own = [own[i] for i in np.flatnonzero(keep).tolist()]
                lost.append(words[-1] - len(own))
                texts.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words, pa.int64()), pa.array(lost, pa.int64())], names=["_rest", "_text", "n_words", "n_removed"])

    done = met.mapInArrow(tidy(rebuild), shape)
    order = [F.col("_text").alias(c) if c == text_col else F.col(f"_rest.{c}") for c in docs.columns if c not in ("n_words", "n_removed")]
    return done.select(*order, "n_words", "n_removed")
