"""SimHash near-duplicates by anchor-point covering.

Fingerprints are SimHashes of word shingles. Links are found without comparing all pairs: the bits are cut
into bands, each with a covering code whose codewords are the anchors. Bands of 23 bits use the perfect
binary Golay code (covering radius 3). A fingerprint is sent as *home* to its nearest anchor of every band
and as *visitor* to every anchor within covering radius plus the band's threshold, 3 + 1. Homes and visitors
are compared per anchor, in tiles of bounded size, and each tile returns a spanning forest of the links it
found, never all pairs.

``near_duplicates`` links 64-bit fingerprints of 4 or fewer differing bits, and finds every such link: the
64 bits are two Golay bands and a rest of 18 bits with the trivial code (every point is an anchor, radius
0). Two fingerprints that differ in at most 4 bits differ in at most 1 bit of a Golay band or in none of the
rest, for 2 + 2 + 1 > 4; that is 12 rows on average.

``similar_texts`` links texts whose shingle sets have a Jaccard similarity of 0.8 or more. Such sets differ in
about 0.15 of their bits, more than any threshold of 64 bits tells from chance, so fingerprints have 320
bits in 13 Golay bands. At a similarity of 0.8 a band brings a pair together with probability 0.40, all
bands with 0.9987, and with more the more similar the texts are; pairs that meet must agree within
``WIDE_THRESHOLD`` of ``WIDE_CHECKED`` bits (3.9 standard deviations above the mean at 0.8). What hangs together
by such links is a candidate group; the exact similarity is then computed within groups, block by block.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadloom.llm.common import group_edges, hinted, rolled, split_words, tidy, whole_groups
from roadloom.operators.graph import connected_components
from roadloom.session import cut, stored

THRESHOLD = 4
GOLAY_BITS, GOLAY_RADIUS, GOLAY_THRESHOLD = 23, 3, 1
GOLAY_GENERATOR = 0b101011100011
TAIL_BITS = 64 - 2 * GOLAY_BITS
SIGN = np.uint64(1 << 63)
#: Homes and visitors of an anchor that one task compares at a time.
TILE = 20_000
#: Wide fingerprints: words of 64 bits, Golay bands, and the bits that a pair must agree in, all but so many.
WIDE_WORDS, WIDE_BANDS, WIDE_CHECKED, WIDE_THRESHOLD = 5, 13, 192, 48
#: The least similarity, as a fraction so that it is tested on whole numbers.
LEAST = (4, 5)
#: Members of a candidate group that one block holds; two blocks are compared at a time.
BLOCK = 256
NO_ID = -(1 << 63)


def fingerprint(data: bytes, width: int, buffer: int = 65_536) -> int:
    """SimHash of one normalised text: majority of the bits of all shingle hashes, repeats included."""
    words = data.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width)), strict=False)) if n > 1 or len(words) >= width else iter([b" ".join(words)])
    digest = xxhash.xxh64_digest  # big-endian, so the unpacked bits come highest first
    total = np.zeros(64, np.int64)
    while part := [digest(x, 42) for x in islice(shingles, buffer)]:
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(doc_id, fp)`` for every row, ``fp`` the fingerprint's bits as a signed long; null or wordless texts give 0."""

    def run(batches):
        for batch in batches:
            raw = batch.column(1).cast(pa.binary())
            out = np.array([fingerprint(x.as_buffer().to_pybytes(), width) if x.is_valid else 0 for x in raw], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, fp long")


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder modulo the Golay generator polynomial, 11 bits."""
    s = words.astype(np.int64).copy()
    for bit in range(GOLAY_BITS - 1, 10, -1):
        s ^= np.where((s >> bit) & 1, GOLAY_GENERATOR << (bit - 11), 0)
    return s


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(leader, patterns, offsets)``: per syndrome the error of weight <= 3, and every error of weight <= 4."""
    errors = np.array([sum(1 << b for b in c) for w in range(GOLAY_RADIUS + GOLAY_THRESHOLD + 1) for c in combinations(range(GOLAY_BITS), w)])
    syndromes = _syndrome(errors)
    order = np.argsort(syndromes, kind="stable")
    errors, syndromes = errors[order], syndromes[order]
    offsets = np.searchsorted(syndromes, np.arange(2049))
    return errors[offsets[:-1]], errors, offsets


def golay_anchors(part: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For 23-bit values: index of the value, anchor key (band and codeword) and whether it is its home."""
    leader, patterns, offsets = golay_tables()
    s = _syndrome(part)
    counts = offsets[s + 1] - offsets[s]
    at = np.repeat(np.arange(len(part)), counts)
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    e = patterns[np.repeat(offsets[s], counts) + inner]
    return at, (band << 32) | (part[at] ^ e), e == leader[s][at]


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``golay_anchors`` for all bands of 64-bit fingerprints."""
    mask = np.uint64((1 << GOLAY_BITS) - 1)
    found = [golay_anchors(((fps >> np.uint64(GOLAY_BITS * band)) & mask).astype(np.int64), band) for band in range(2)]
    found.append((np.arange(len(fps)), (2 << 32) | (fps >> np.uint64(2 * GOLAY_BITS)).astype(np.int64), np.ones(len(fps), bool)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def wide_anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``golay_anchors`` for all bands of fingerprints of ``WIDE_WORDS`` words, one a row."""
    found = []
    for band in range(WIDE_BANDS):
        word, low = divmod(band * GOLAY_BITS, 64)
        part = fps[:, word] >> np.uint64(low)
        if low + GOLAY_BITS > 64:
            part = part | fps[:, word + 1] << np.uint64(64 - low)
        found.append(golay_anchors((part & np.uint64((1 << GOLAY_BITS) - 1)).astype(np.int64), band))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Parents after the links ``a`` to ``b``; every node ends up below the least of its component."""
    parent = _roots(parent)
    while True:
        ra, rb = parent[a], parent[b]
        open_ = ra != rb
        if not open_.any():
            return parent
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        parent = _roots(parent)


def forest(home_ids: np.ndarray, homes: np.ndarray, visitor_ids: np.ndarray, visitors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links (distance <= most) between two tables of fingerprints, a row each, as (member, root) pairs of ids."""
    nodes = np.unique(np.concatenate((home_ids, visitor_ids)))
    parent = np.arange(len(nodes))
    h, v = np.searchsorted(nodes, home_ids), np.searchsorted(nodes, visitor_ids)
    step = max(1, 2_000_000 // max(1, len(visitors)))
    for at in range(0, len(homes), step):
        part = homes[at : at + step]
        differ = sum(np.bitwise_count(part[:, None, k] ^ visitors[None, :, k]).astype(np.uint16) for k in range(homes.shape[1]))
        rows, cols = np.nonzero(differ <= most)
        a, b = h[at + rows], v[cols]
        keep = a != b
        if keep.any():
            parent = unite(parent, a[keep], b[keep])
    out = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[out], nodes[parent[out]]


def meeting_links(placed: DataFrame, words: list[str], most: int, tile: int = TILE) -> DataFrame:
    """``(src, dst)`` links between ids whose fingerprints meet at an anchor and differ in at most ``most`` bits.

    ``placed`` has columns ``anchor, home, id`` and the fingerprint's words. Anchors of more than ``tile`` rows
    are split into tiles of about ``tile`` homes and ``tile`` visitors, visitors going to every tile of the
    homes. The table of their sizes is broadcast: there are no more anchors than codewords, at most 2^18 + 2^13
    here, however many rows.
    """
    sizes = placed.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("nh")).where(F.col("n") > tile)
    sizes = sizes.select("anchor", F.greatest(F.lit(1), F.ceil(F.col("nh") / tile)).cast("int").alias("kh"), F.ceil(F.col("n") / tile).cast("int").alias("kv"))
    own = lambda c: f"cast(pmod(xxhash64(id), {c}) AS int)"
    # role 0: visitor, 1: home, 2: both, where the anchor is one tile
    split = F.expr(
        f"CASE WHEN kv IS NULL THEN array(named_struct('role', if(home, 2, 0), 'i', 0, 'j', 0)) ELSE concat(transform(sequence(0, kh - 1), i -> named_struct('role', 0, 'i', i, 'j', {own('kv')})),"
        f" if(home, transform(sequence(0, kv - 1), j -> named_struct('role', 1, 'i', {own('kh')}, 'j', j)), array())) END"
    )
    tiled = placed.join(F.broadcast(sizes), "anchor", "left").select("anchor", "id", *words, F.inline(split))

    def compare(batches):
        for t in whole_groups(batches, ["anchor", "i", "j"]):
            ids, role = t.column("id").to_numpy(), t.column("role").to_numpy()
            prints = np.stack([t.column(c).to_numpy().view(np.uint64) for c in words], axis=1)
            edges = group_edges(t, ["anchor", "i", "j"])
            out = [np.zeros((2, 0), np.int64)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if hi - lo > 1:
                    h, v = np.flatnonzero(role[lo:hi] >= 1) + lo, np.flatnonzero(role[lo:hi] != 1) + lo
                    if len(h) and len(v):
                        out.append(np.stack(forest(ids[h], prints[h], ids[v], prints[v], most)))
            got = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["src", "dst"])

    dealt = tiled.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j").select("anchor", "i", "j", "id", "role", *words)
    return dealt.mapInArrow(tidy(compare), "src long, dst long").distinct()


def near_links(fps: DataFrame, tile: int = TILE) -> DataFrame:
    """``(src, dst)`` links that connect every two distinct fingerprints of ``fps`` (column ``fp``) within the threshold."""

    def spread(batches):
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at, key, home = anchors(values.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(home), pa.array(values[at]), pa.array(values[at])], names=["anchor", "home", "id", "w0"])

    placed = fps.select("fp").mapInArrow(tidy(spread), "anchor long, home boolean, id long, w0 long")
    return meeting_links(placed, ["w0"], THRESHOLD, tile)


def hex64(col) -> F.Column:
    return F.lower(F.lpad(F.hex(col), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row per input row.

    Exact copies share a fingerprint and meet before any comparison, so a group of copies costs one row.
    Rows with a null text or no words have fingerprint zero and link like others; repeated rows are kept;
    a null id gives a row with that null id, whose component is the smallest id of its links (null if it
    has none). An empty table gives an empty result; columns other than the two named are not read.
    """
    prints = cut(fingerprints(docs, id_col, text_col, width))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(near_links(groups.select("fp")))
    named = hinted(_least_ids(groups, parts, "fp"))
    return prints.join(named, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def _least_ids(groups: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """``(key, component_id)``: the least id of each component, of a row alone its own; most rows are in no component."""
    within = parts.join(groups, parts.id == groups[key]).select("id", "component", "least")
    lowest = hinted(within.groupBy("component").agg(F.min("least").alias("component_id")))
    linked = within.join(lowest, "component").select(F.col("id").alias(key), "component_id")
    return groups.join(hinted(linked), key, "left").select(key, F.coalesce("component_id", "least").alias("component_id"))


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of a batch of texts end to end, where each text's begin, and a hash of all of a text's words.

    A text of fewer than ``width`` words is one shingle; one without words has none, and 0 for its hash.
    """
    flat, offsets = split_words(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = flat.dictionary_encode()
    one = xxhash.xxh3_64_intdigest
    words = np.array([one(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    n = np.diff(offsets)
    bounds = offsets.tolist()
    key = np.array([one(words[a:b].tobytes()) if b > a else 0 for a, b in zip(bounds[:-1], bounds[1:], strict=True)], np.uint64)
    whole = np.maximum(0, n - width + 1)
    doc = np.repeat(np.arange(len(n)), whole)
    start = np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
    value = rolled(words, width)[offsets[doc] + start] if len(doc) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < width))
    doc, value = np.concatenate((doc, short)), np.concatenate((value, key[short]))
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate(([True], (np.diff(doc) != 0) | (np.diff(value) != 0)))[: len(doc)]
    return value[new], np.searchsorted(doc[new], np.arange(len(n) + 1)), key


#: Byte to eight counters of eight bits each, one for each of its bits.
_LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def wide_fingerprints(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """SimHashes of ``WIDE_WORDS`` words of texts given by their shingle hashes, one a row; 0 where there are none."""
    n = np.diff(offsets)
    out = np.zeros((len(n), WIDE_WORDS), np.uint64)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    # counters of eight bits hold 255 shingles: longer texts are counted in parts
    parts = -(-n[some] // 255)
    first = np.cumsum(parts) - parts
    starts = np.repeat(offsets[:-1][some], parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counts = np.empty((len(starts), 8 * WIDE_WORDS), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WIDE_WORDS):
            x = values * _FACTORS[k]
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xC4CEB9FE1A85EC53)
            x ^= x >> np.uint64(29)
            byte = x.view(np.uint8).reshape(-1, 8)
            for j in range(8):
                counts[:, 8 * k + j] = np.add.reduceat(_LANES[byte[:, j]], starts)
    bits = np.add.reduceat(counts.view(np.uint8).reshape(len(starts), -1).astype(np.int32), first, axis=0)
    out[some] = np.packbits(2 * bits > n[some, None], axis=1, bitorder="little").view(np.uint64)
    return out


def alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as (member, root) places, of the sets of hashes whose similarity is at least ``LEAST``."""
    p, q = LEAST
    n = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), n)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    new = np.concatenate(([True], np.diff(values) != 0))
    run = np.cumsum(new) - 1
    common = np.bincount(run) > 1
    kept = common[run]
    place, owner = (np.cumsum(common) - 1)[run[kept]], owner[kept]
    shared = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(common.sum()), 4096):
        own = slice(*np.searchsorted(place, [lo, lo + 4096]))
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[own], place[own] - lo] = 1
        shared += m @ m.T
    a, b = np.nonzero(np.triu(shared * (p + q) >= p * (n[:, None] + n[None, :]), 1))
    parent = unite(np.arange(len(sets)), a, b)
    out = np.flatnonzero(parent != np.arange(len(sets)))
    return out, parent[out]


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, block: int = BLOCK) -> DataFrame:
    """``(doc_id, component_id)``, one row per input row: the least id of all texts that links of similarity reach.

    Words are lower-cased (A-Z). Rows whose text is null or has no words are alike; texts of the same words
    meet before any comparison; a text of fewer words than ``width`` is one shingle; very long texts are
    taken whole; repeated rows are kept; a null id gives a row with that null id, whose component is the
    least id of its links (null if it has none). An empty table gives an empty result; columns other than
    the two named are not read. Shingles and texts are compared as 64-bit hashes.
    """
    words = [f"w{k}" for k in range(WIDE_WORDS)]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    ident = F.col(id_col).cast("long")
    slim = docs.select(ident.alias("doc_id"), F.xxhash64(text).alias("tid"), text.alias("text"))

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                values, offsets, key = shingles(part.column(2), width)
                prints = wide_fingerprints(values, offsets).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(key.view(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in prints.T)], names=["doc_id", "tid", "key", *words])

    rows = stored(slim.mapInArrow(tidy(read), "doc_id long, tid long, key long, " + ", ".join(f"{w} long" for w in words)))
    # any row of a text stands for it: the least by id, which its text is read again by
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.col("tid"))).alias("rep")
    groups = stored(rows.groupBy("key").agg(F.min("doc_id").alias("least"), rep, *(F.first(w).alias(w) for w in words)))

    def spread(batches):
        for batch in batches:
            prints = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, WIDE_WORDS + 1)], axis=1).view(np.uint64)
            at, anchor, home = wide_anchors(prints)
            cols = [pa.array(anchor), pa.array(home), batch.column(0).take(pa.array(at)), *(batch.column(1 + k).take(pa.array(at)) for k in range(WIDE_CHECKED // 64))]
            yield pa.RecordBatch.from_arrays(cols, names=["anchor", "home", "id", *words[: WIDE_CHECKED // 64]])

    checked = words[: WIDE_CHECKED // 64]
    placed = groups.where("key <> 0").select("key", *words).mapInArrow(tidy(spread), "anchor long, home boolean, id long, " + ", ".join(f"{w} long" for w in checked))
    maybe = connected_components(meeting_links(placed, checked, WIDE_THRESHOLD))
    parts = connected_components(_confirmed(slim, groups, cut(maybe), width, block))
    return rows.select("doc_id", "key").join(hinted(_least_ids(groups.select("key", "least"), parts, "key")), "key").select("doc_id", "component_id")


def _confirmed(slim: DataFrame, groups: DataFrame, maybe: DataFrame, width: int, block: int) -> DataFrame:
    """``(src, dst)``: a spanning forest of the links between the keys of every candidate group.

    A group is dealt into blocks of about ``block`` members by hash, and any two blocks meet in one task
    that computes all similarities between them: no group is gathered as a whole, and a text is sent once
    for each block of its group.
    """
    sizes = hinted(maybe.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    members = maybe.join(sizes, "component").join(groups.select("key", "rep"), F.col("id") == F.col("key"))
    members = hinted(members.select(F.col("rep.d").alias("d"), F.col("rep.tid").alias("tid"), "key", "component", "blocks"))
    texts = slim.withColumn("d", F.coalesce("doc_id", F.lit(NO_ID))).join(members, ["d", "tid"]).select("key", "component", "blocks", "text")

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                values, offsets, _ = shingles(part.column(3), width)
                raw = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(raw, pa.binary())], names=["key", "component", "blocks", "grams"])

    sets = texts.mapInArrow(tidy(read), "key long, component long, blocks int, grams binary")
    own = "cast(pmod(xxhash64(key), blocks) AS int)"
    dealt = sets.select("key", "component", F.inline(F.expr(f"transform(sequence(0, blocks - 1), k -> named_struct('i', least(k, {own}), 'j', greatest(k, {own})))")), "grams")

    def check(batches):
        for t in whole_groups(batches, ["component", "i", "j"], 2000):
            keys = t.column("key").to_numpy()
            edges = group_edges(t, ["component", "i", "j"])
            out = [np.zeros((2, 0), np.int64)]
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if hi - lo > 1:
                    a, b = alike([np.frombuffer(x.as_py(), np.uint64) for x in t.column("grams").slice(lo, hi - lo)])
                    out.append(np.stack((keys[lo + a], keys[lo + b])))
            got = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(got[0]), pa.array(got[1])], names=["src", "dst"])

    met = dealt.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").select("component", "i", "j", "key", "grams")
    return met.mapInArrow(tidy(check), "src long, dst long").distinct()


def pairs_by_brute_force(fps: list[int], most: int = THRESHOLD) -> set[tuple[int, int]]:
    """All linked pairs of distinct fingerprints; for tests on small inputs."""
    u = np.array(sorted(set(fps)), np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= most
    return {(int(u[a]), int(u[b])) for a, b in zip(*np.nonzero(near), strict=True) if a < b}


__all__ = ["fingerprint", "fingerprints", "near_links", "near_duplicates", "similar_texts"]
