"""Deduplication operators against brute force, on small tables with nulls, ties, copies and long texts."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from roadloom.llm import lines, simhash, substrings

SPACE = "\x20\t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["Ärger", "é", "x" * 3000]
    passage = " ".join(r.choice(vocab) for _ in range(45))
    line = "This line is shared by a lot of documents"
    rows = []
    for k in range(n):
        text = "\n".join(" ".join(r.choice(vocab[:-1]) for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 4)))
        if k % 5 == 0:
            text += " " + passage
        if k % 4 == 0:
            text += "\n  " + (line.upper() if k % 8 else line) + "\t"
        rows.append((k, text))
    rows += [(n, rows[3][1]), (n + 1, rows[3][1] + " tail"), (n + 2, None), (n + 3, ""), (n + 4, " \n\t "), (n + 5, " ".join(["again"] * 70)), (n + 6, " ".join(r.choice(vocab) for _ in range(20000)))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "b") for i, t in rows], "doc_id long, text string, n_words int, least string")


@pytest.mark.parametrize("batch", ["10000", "7"])
def test_substrings_equal_brute_force(spark, batch):
    rows = corpus()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substrings.drop_repeated(frame(spark, rows).repartition(3)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    first, want = {}, {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    for i, t in rows:
        w, gone = WORD.findall(t or ""), set()
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (i, s):
                gone.update(range(s, s + 20))
        want[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    assert got == want
    assert sum(x[1] for x in want.values()) > 300


def test_substrings_ties_and_empty(spark):
    p = " ".join(f"v{k}" for k in range(25))
    d = spark.createDataFrame([(1, p), (1, p), (None, p), (2, p)], "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_removed) for r in substrings.drop_repeated(d).collect())
    assert got == {(None, 0): 1, (1, 25): 2, (2, 25): 1}
    assert substrings.drop_repeated(d.where("false")).count() == 0


@pytest.mark.parametrize("limit", [lines.BROADCAST_BYTES, 0])
def test_lines_equal_brute_force(spark, limit):
    rows = [*corpus(), (None, "one line that only repeated rows hold"), *[(990, "one line that only repeated rows hold")] * 4, (None, "a line of more than twenty characters"), (900, "A line of more than twenty characters"), (901, " a line of more than twenty characters\na line of more than twenty characters")]
    key = lambda x: lower(x.strip(SPACE))
    holders = collections.defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(-1 if i is None else i)
    want = {}
    for i, t in rows:
        every = (t or "").split("\n")
        kept = [x for x in every if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == (-1 if i is None else i)]
        want[i] = (len(every), len(every) - len(kept), "\n".join(kept))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in lines.drop_shared_lines(frame(spark, rows), broadcast_bytes=limit).collect()}
    assert got == want
    assert lines.drop_shared_lines(frame(spark, rows[:1]).where("false"), broadcast_bytes=limit).count() == 0


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64))
    h = lines.PerfectHash(keys)
    assert sorted(h.index(keys).tolist()) == list(range(len(keys)))
    assert lines.PerfectHash(keys[:0]).index(keys).max() == -1


def brute_fingerprint(text, width):
    w = [x.encode() for x in map(lower, WORD.findall(text or ""))]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + width]), 42) for k in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components(spark):
    rows = [(i, t) for i, t in corpus(n=30) if t is None or len(t) < 20000]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    prints = {i: brute_fingerprint(t, 4) for i, t in rows}
    assert {i: f for i, (f, _) in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    root = {i: i for i in prints}
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    assert {i: c for i, (_, c) in got.items()} == root
    assert simhash.near_duplicates(frame(spark, rows[:1]).where("false")).count() == 0


@pytest.mark.parametrize("tile", [20000, 40])
def test_links_equal_brute_force(spark, tile):
    r = random.Random(4)
    fps = set()
    for _ in range(40):
        base = r.getrandbits(64)
        fps.add(base)
        for _ in range(6):
            fps.add(base ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))))
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in fps]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), tile).collect()
    parent = {x[0]: x[0] for x in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() >= 1
        parent[find(a)] = find(b)
    mask = (1 << 64) - 1
    other = {x & mask: x & mask for x in parent}

    def find2(x):
        while other[x] != x:
            x = other[x]
        return x

    for a, b in simhash.pairs_by_brute_force(list(other)):
        other[find2(a)] = find2(b)
    groups = lambda p, f: sorted(sorted(v & mask for v in p if f(v) == k) for k in {f(v) for v in p})
    assert groups(parent, find) == groups(other, find2)


def test_near_duplicate_stage_equals_brute_force(spark):
    r = random.Random(9)
    vocab = [f"w{k}" for k in range(500)]
    rows = [(k, " ".join(r.choice(vocab) for _ in range(r.randint(30, 300)))) for k in range(40)]
    for k in range(40):
        w = rows[k][1].split()
        for share in (0.95, 0.9, 0.85, 0.8, 0.7):  # each changed word costs about five shingles
            v = list(w)
            for at in r.sample(range(len(v)), max(1, round(len(v) * (1 - share) / 9))):
                v[at] = "changed" + str(r.randrange(99))
            rows.append((len(rows), " ".join(v)))
    shared = " ".join(r.choice(vocab) for _ in range(100))
    rows += [(len(rows) + k, shared + f" end{k}") for k in range(60)]
    rows += [(900, None), (901, ""), (902, "one two"), (903, "One  two"), (904, rows[0][1].upper()), (None, rows[1][1])]
    grams = {}
    for i, t in rows:
        w = [lower(x) for x in WORD.findall(t or "")]
        grams[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in grams if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for a in root:
        for b in root:
            shares = len(grams[a] & grams[b])
            if a < b and 5 * shares >= 4 * (len(grams[a]) + len(grams[b]) - shares):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                far += (brute_fingerprint(dict(rows)[a], 5) ^ brute_fingerprint(dict(rows)[b], 5)).bit_count() > 4
    assert far > 50
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = [x.doc_id for x in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()]
    assert sorted(x for x in got if x is not None) == sorted(i for i in root if find(i) == i)
    assert got.count(None) == 1
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where("false"), "").count() == 0
