"""Token counts without token ids.

Pre-tokens here are the space-led units of a text: a unit ends before every space that a non-space
follows. The library's own splitting never crosses such a place, so the pieces of a text are the sum of
the pieces of its units; long units are cut further, into what the library's own pre-tokenizer makes of
them. Units are counted once per distinct unit of the corpus; documents are reduced to
unit frequencies; the two are joined and summed. The most frequent units (at most ``head``, a fixed bound)
are joined by broadcast, the long tail by a shuffle of what little is left, so no table that grows with the
corpus is ever broadcast or collected.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import tidy
from roadloom.session import stored

LIMIT = 1024
#: Units joined by broadcast; about 12 MB at most, since longer units than ``HEAD_BYTES`` stay in the tail.
HEAD, HEAD_BYTES = 400_000, 24
#: Longer units are cut into the library's own pre-tokens.
LONG = 64
_GAP = re.compile(r" (?=\S)")
_OPENED: dict[str, object] = {}


def tokenizer(path: str):
    """The ``tokenizers`` or ``sentencepiece`` model at ``path``, opened once per process."""
    if path not in _OPENED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            _OPENED[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.no_truncation()
            t.no_padding()
            _OPENED[path] = t
    return _OPENED[path]


def count_pieces(units: list[str], path: str) -> np.ndarray:
    t = tokenizer(path)
    if path.endswith(".model"):
        return np.array([len(x) for x in t.encode(units, num_threads=1)], np.int64)
    return np.array([len(x) for x in t.encode_batch_fast(units, add_special_tokens=False)], np.int64)


def pre_tokens(unit: str, path: str | None) -> list[str]:
    """A unit as the pre-tokens that the library cuts it into; whole where they cannot be told from the text alone.

    A pre-token encoded by itself is one pre-token again. Special strings are found before pre-tokens are, and
    a normaliser may change the text, so units with either stay whole.
    """
    if path is None or path.endswith(".model") or "<|" in unit:
        return [unit]
    t = tokenizer(path)
    if t.normalizer is not None or t.pre_tokenizer is None:
        return [unit]
    return [unit[a:b] for _, (a, b) in t.pre_tokenizer.pre_tokenize_str(unit)] or [unit]


def units(texts: pa.Array, path: str | None = None) -> tuple[pa.Array, np.ndarray]:
    """All units of a batch of texts (dictionary encoded) and where each text's units start.

    A unit keeps its leading space; U+0001 marks one without. Texts in which a space meets other white space
    or the end take the slower split, which gives units by the same rule. Units of more than ``LONG`` bytes,
    as texts without spaces have, are cut into pre-tokens.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    odd = pc.match_substring_regex(texts, r" (?:[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)")
    simple = pc.split_pattern(pc.if_else(odd, "", texts), " ")
    flat, offsets = simple.flatten(), np.asarray(simple.offsets).astype(np.int64)
    # U+0001 marks a text's first unit; the others get their space back when they are read
    first = np.zeros(len(flat), bool)
    first[offsets[:-1]] = True
    flat = pc.binary_join_element_wise(pc.if_else(pa.array(first), "\x01", " "), flat, "")
    where = np.flatnonzero(np.asarray(odd))
    if len(where):
        pieces = [_GAP.split(texts[int(i)].as_py()) for i in where]
        sizes = np.diff(offsets)
        marked = [["\x01" + p[0], *(" " + x for x in p[1:])] for p in pieces]
        parts, at = [], 0
        for i, m in zip(where.tolist(), marked, strict=True):
            parts += [flat.slice(at, int(offsets[i]) - at), pa.array(m, pa.string())]
            at = int(offsets[i + 1])
            sizes[i] = len(m)
        flat = pa.concat_arrays([*parts, flat.slice(at)])
        offsets = np.concatenate(([0], np.cumsum(sizes)))
    long_ones = np.flatnonzero(np.asarray(pc.greater(pc.binary_length(flat), LONG)))
    if len(long_ones) and path is not None:
        parts, at, extra = [], 0, np.zeros(len(flat), np.int64)
        for i in long_ones.tolist():
            unit = flat[i].as_py()
            first, *rest = pre_tokens(plain(unit), path)
            parts += [flat.slice(at, i - at), pa.array([first if unit[0] == " " and first[0] == " " else "\x01" + first, *("\x01" + x for x in rest)], pa.string())]
            at, extra[i] = i + 1, len(rest)
        flat = pa.concat_arrays([*parts, flat.slice(at)])
        offsets = offsets + np.concatenate(([0], np.cumsum(extra)))[offsets]
    return flat.dictionary_encode(), offsets


def plain(unit: str) -> str:
    """The text of a unit as kept in tables."""
    return unit[1:] if unit[0] == "\x01" else unit


def unit_frequencies(docs: DataFrame, text_col: str, path: str | None = None) -> DataFrame:
    """``(unit, n)``: frequency of every unit of the corpus, one row per unit."""

    def run(batches):
        for batch in batches:
            got, _ = units(batch.column(0), path)
            n = np.bincount(got.indices.to_numpy(), minlength=len(got.dictionary))
            yield pa.RecordBatch.from_arrays([got.dictionary, pa.array(n)], names=["unit", "n"])

    return docs.select(text_col).mapInArrow(tidy(run), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def piece_counts(frequencies: DataFrame, path: str) -> DataFrame:
    """Adds ``pieces``: each distinct unit is encoded once."""

    def run(batches):
        for batch in batches:
            n = count_pieces([plain(x) for x in batch.column(0).to_pylist()], path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n)], names=["unit", "n", "pieces"])

    return frequencies.mapInArrow(tidy(run), "unit string, n long, pieces long")


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)``, one row per input row.

    Null texts count as empty (0 bytes, 0 tokens); repeated rows and null ids are kept as they are; special
    strings inside texts are handled as the library does; very long texts, with or without spaces, are taken
    whole; an empty table gives an empty result. Columns other than the two named are not read.
    """
    spark = docs.sparkSession
    counts = stored(piece_counts(unit_frequencies(docs, text_col, path), path))
    short = counts.where(F.octet_length("unit") <= HEAD_BYTES)
    # at most ``head`` rows: the frequency of the head-th unit, read off a histogram of powers of two
    levels = short.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).count().orderBy(F.desc("k")).collect()
    total, floor = 0, None
    for k, n in levels:
        if total + n > head:
            break
        total, floor = total + n, k
    known = short.where(F.col("n") >= 2**floor).select("unit", "pieces").toArrow() if floor is not None else pa.table({"unit": pa.array([], pa.string()), "pieces": pa.array([], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, known.schema) as w:
        w.write_table(known)
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    everything = floor is not None and total == sum(n for _, n in levels) and counts.where(F.octet_length("unit") > HEAD_BYTES).isEmpty()

    def run(batches):
        with pa.ipc.open_stream(shared.value) as r:
            t = r.read_all().combine_chunks()
        keys = t.column("unit").combine_chunks().cast(pa.string()) if t.num_rows else pa.array([], pa.string())
        values = t.column("pieces").to_numpy() if t.num_rows else np.zeros(0, np.int64)
        for batch in batches:
            got, offsets = units(batch.column(1), path)
            found = pc.index_in(got.dictionary, value_set=keys)
            at = pc.fill_null(found, -1).to_numpy()
            each = np.where(at >= 0, values[at] if len(values) else 0, 0)
            codes = got.indices.to_numpy()
            sums = np.concatenate(([0], np.cumsum(each[codes])))
            base = sums[offsets[1:]] - sums[offsets[:-1]]
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            missing = np.flatnonzero((at < 0)[codes])
            doc = np.searchsorted(offsets, missing, side="right") - 1
            pair, n = np.unique(doc * np.int64(len(got.dictionary)) + codes[missing], return_counts=True)
            whose, what = np.divmod(pair, max(1, len(got.dictionary)))
            ends = np.searchsorted(whose, np.arange(batch.num_rows + 1))
            tail = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), pa.StructArray.from_arrays([got.dictionary.take(pa.array(what)).cast(pa.string()), pa.array(n, pa.int64())], names=["unit", "freq"])
            )
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n_bytes, pa.array(base, pa.int64()), tail], names=["row", "doc_id", "n_bytes", "base", "tail"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"), F.col(id_col).alias("doc_id"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    read = rows.mapInArrow(tidy(run), f"row long, doc_id {kind}, n_bytes long, base long, tail array<struct<unit:string,freq:long>>")
    if everything:
        summed = read.select("doc_id", "n_bytes", F.col("base").alias("n_tokens"))
    else:
        # a document itself is a row without a unit: it passes the join under a key of its own
        flat = read.select(
            "row", "doc_id", "n_bytes", "base", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("string").alias("unit"), F.lit(0).cast("long").alias("freq"))), "tail")).alias("t")
        )
        flat = flat.select("row", F.when(F.col("t.unit").isNull(), F.struct("doc_id", "n_bytes", "base")).alias("doc"), F.coalesce("t.unit", F.concat(F.lit("\x02"), "row")).alias("unit"), "t.freq")
        joined = flat.join(counts.select("unit", "pieces"), "unit", "left")
        summed = (
            joined.groupBy("row")
            .agg(F.max("doc").alias("doc"), F.sum(F.col("freq") * F.col("pieces")).alias("rest"))
            .select("doc.doc_id", "doc.n_bytes", (F.col("doc.base") + F.coalesce("rest", F.lit(0))).alias("n_tokens"))
        )
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)
