"""Packing of documents into fixed-length sequences by first-fit decreasing.

Documents are tokenised, closed by an end id and cut every ``size`` ids. Pieces are dealt at random into
groups; each group is packed on its own by first-fit decreasing, where a tournament tree over the bins'
free space finds the first bin that fits in logarithmic time. Nothing is remembered between batches. Unless
ids are asked for, only lengths and checksums are shuffled.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import tidy
from roadloom.llm.tokens import tokenizer

SIZE, END_ID = 2048, 1
#: Bytes of text that make up a group, that share a dictionary of units, and whose ids are laid out at a time.
GROUP_BYTES, SHARED_BYTES, PART_BYTES = 16 << 20, 24 << 20, 4 << 20
#: Units that the library encodes as one text, those of ASCII, Latin-1 letters and line ends, and what it splits them into.
TOGETHER, PLAIN = 500, r"^[\n\x21-\x7e\x{c0}-\x{ff}]*$"
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def cut_by_bytes(texts: pa.Array, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most ``most`` bytes of text, or of one row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, lo = [], 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        out.append((lo, hi))
        lo = hi
    return out


def unit_ids(units: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many units end to end, and how many each has.

    The tokenizer drops white space and never looks across it, so units of plain characters are encoded many
    at a time, joined by spaces: the library numbers the pre-tokens of a text, and a unit has as many as its
    pattern finds in it. A text whose pre-tokens are not as many as expected is encoded unit by unit, as
    units of other characters or special strings are.
    """
    library = tokenizer(path)
    together = np.asarray(pc.and_(pc.match_substring_regex(units, PLAIN), pc.invert(pc.match_substring(units, "<|"))))
    at = np.flatnonzero(together)
    plain = units.take(pa.array(at))
    expected = pc.count_substring_regex(pc.utf8_lower(plain), PRE_TOKEN).to_numpy().astype(np.int64)
    names = plain.to_pylist()
    sizes, alone = np.zeros(len(units), np.int64), list(np.flatnonzero(~together))
    found: list[tuple[np.ndarray, np.ndarray]] = []  # units and their ids
    cuts = range(0, len(names), TOGETHER)
    for k, e in zip(cuts, library.encode_batch([" ".join(names[k : k + TOGETHER]) for k in cuts], add_special_tokens=False), strict=True):
        number, n = np.array(e.word_ids, np.int64), expected[k : k + TOGETHER]
        own = at[k : k + TOGETHER]
        if len(number) and number[-1] + 1 != n.sum() or not len(number) and n.sum():
            alone += list(own)
            continue
        sizes[own] = np.diff(np.searchsorted(number, np.concatenate(([0], np.cumsum(n)))))
        found.append((own, np.array(e.ids, np.uint32)))
    for k, e in zip(alone, library.encode_batch_fast(units.take(pa.array(alone, pa.int64())).to_pylist(), add_special_tokens=False), strict=True):
        sizes[k] = len(e.ids)
        found.append((np.array([k]), np.array(e.ids, np.uint32)))
    order = np.concatenate([np.zeros(0, np.int64), *(x for x, _ in found)])
    starts = np.zeros(len(units), np.int64)
    starts[order] = np.cumsum(sizes[order]) - sizes[order]
    return np.concatenate([np.zeros(0, np.uint32), *(x for _, x in found)]), np.stack((starts, sizes))


def batch_ids(texts: pa.Array, path: str, end_id: int):
    """For ranges of rows of a batch: the first row, the token ids of its texts end to end, each closed by ``end_id``, and the texts' bounds.

    Texts are cut at spaces, and each distinct unit of the batch is encoded once.
    """
    flat = pc.split_pattern(pc.fill_null(texts.cast(pa.string()), ""), " ")
    offsets = np.asarray(flat.offsets).astype(np.int64)
    words = flat.flatten().dictionary_encode()
    ids, (starts, sizes) = unit_ids(words.dictionary, path)
    # the end id is one more unit, after the units of every text
    every, end = words.indices.to_numpy(), len(starts)
    starts, sizes, ids = np.append(starts, len(ids)), np.append(sizes, 1), np.append(ids, np.uint32(end_id))
    for lo, hi in cut_by_bytes(texts, PART_BYTES):
        own = offsets[lo : hi + 1] - offsets[0]
        codes = np.insert(every[own[0] : own[-1]], own[1:] - own[0], end)
        n = sizes[codes]
        ends = np.cumsum(n)
        out = ids[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1])]
        yield lo, out, np.concatenate(([0], ends[own[1:] - own[0] + np.arange(hi - lo)]))


def first_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of every item; ``lengths`` must fall. Bins number from 0 in order of opening."""
    n = 1
    while n < max(1, len(lengths)):
        n *= 2
    free = [size] * (2 * n)
    bins, offsets = [], []
    for x in lengths:
        k = 1
        while k < n:
            k *= 2
            if free[k] < x:
                k += 1
        bins.append(k - n)
        offsets.append(size - free[k])
        free[k] -= x
        k //= 2
        while k:
            top = max(free[2 * k], free[2 * k + 1])
            if free[k] == top:
                break
            free[k] = top
            k //= 2
    return bins, offsets


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, ids: bool = True, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids])``, one row per piece.

    ``ids`` holds little-endian unsigned 32-bit ids. A null or empty text is its end id alone. Repeated rows
    and null ids are packed like any other row; a very long text is cut like any other. Equal lengths are placed
    by id, then start. An empty table gives an empty result. Columns other than the two named are not read.
    """
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0
    n_groups = max(1, -(-total // group_bytes))

    def cut_up(batches):
        for batch in batches:
            for lo, hi in cut_by_bytes(batch.column(2), SHARED_BYTES):
                for first, every, bounds in batch_ids(batch.column(2).slice(lo, hi - lo), path, end_id):
                    n = np.diff(bounds)
                    pieces = -(-n // size)
                    which = np.repeat(np.arange(len(n)), pieces)
                    start = size * (np.arange(len(which)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                    length = np.minimum(size, n[which] - start)
                    raw, at = memoryview(every.astype("<u4")).cast("B"), 4 * (bounds[which] + start)
                    held = [raw[a:b] for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                    crc = np.fromiter(map(zlib.crc32, held), np.int64, len(held))
                    of = pa.array(which + lo + first)
                    cols = [batch.column(0).take(of), batch.column(1).take(of), *(pa.array(x.astype(np.int64)) for x in (start, length, crc, n[which]))]
                    names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array([bytes(x) for x in held], pa.binary())] if ids else cols, names=[*names, "ids"] if ids else names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    held = ", ids binary" if ids else ""
    pieces = rows.mapInArrow(tidy(cut_up), f"row long, doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{held}")
    pieces = pieces.withColumn("pack_group", F.pmod(F.xxhash64("row", "start"), F.lit(n_groups)))

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(t.column("length").to_pylist(), size)
        base = t.column("pack_group")[0].as_py() << 32
        t = t.append_column("sequence_id", pa.array(np.array(bins, np.int64) + base)).append_column("offset", pa.array(offsets, pa.int64()))
        return t.drop_columns(["row", "pack_group"])

    order = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long{held}, sequence_id long, offset long"
    return pieces.groupBy("pack_group").applyInArrow(fill, order)
