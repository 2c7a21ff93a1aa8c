"""Personal data: exact base patterns, and spans that a character BiLSTM-CRF adds.

The tagger is trained in numpy from labelled spans (``labelled_texts`` makes a training set by rule). Texts
are read in overlapping windows; every window is decoded on its own by Viterbi, and the spans of all windows
of a text are reconciled globally by weighted interval scheduling on their scores. An added span must hold a
digit or an at-sign, pass its kind's check and touch no base span; so a window without a digit or at-sign
cannot add one and needs no decoding, however long the text.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, HIDDEN, STEPS, BATCH, SEED = 96, 48, 16, 600, 40, 3
MIN_SCORE = 0.5
_AT = re.compile(r"@")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a start inside a run of digits matches nothing that the run's own start does not: skipping it keeps this linear
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
TRIGGER = r"[0-9@]"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """The base patterns' spans, by start, then kind as listed."""
    out: list[Span] = []
    end = 0
    for m in _AT.finditer(text):
        at = m.start()
        if at < end:
            continue
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(text, at + 1)
        if start < at and host:
            out.append(("email", start, host.end()))
            end = host.end()
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m.groups()))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- the tagger

_MARKS = " @.+-()_/\\:;,\"'=#*%&<>[]{}|!?\n"
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _code_table() -> np.ndarray:
    """Class of every code point below 128: digits as one, each letter regardless of case, capitals as one, marks, the rest."""
    out = np.full(129, 28 + len(_MARKS), np.int64)
    out[48:58], out[65:91], out[97:123] = 0, 27, np.arange(1, 27)
    for k, c in enumerate(_MARKS):
        out[ord(c)] = 28 + k
    return out


_CODE_TABLE = _code_table()


def _codes(text: str) -> np.ndarray:
    """Character classes of a text; code points from 128 on are of the last class."""
    return _CODE_TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), 128)]


CODES = 29 + len(_MARKS)


def _allowed() -> np.ndarray:
    """Scores that forbid an inside tag that continues nothing."""
    t = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        t[:, inside] = -1e4
        t[[inside - 1, inside], inside] = 0
    return t


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
    """One LSTM over (batch, time, 4 gates) inputs: hidden states and what the backward pass needs."""
    n, length, h4 = x.shape
    h, c = np.zeros((n, h4 // 4), x.dtype), np.zeros((n, h4 // 4), x.dtype)
    out, kept = np.empty((n, length, h4 // 4), x.dtype), []
    for t in range(length):
        z = x[:, t] + h @ u
        i, f, o, g = _sigmoid(z[:, : h4 // 4]), _sigmoid(z[:, h4 // 4 : h4 // 2] + 1), _sigmoid(z[:, h4 // 2 : 3 * h4 // 4]), np.tanh(z[:, 3 * h4 // 4 :])
        before, c_before = h, c
        c = f * c + i * g
        th = np.tanh(c)
        h = o * th
        out[:, t] = h
        kept.append((before, c_before, i, f, o, g, th))
    return out, kept


def _run_back(dh_out: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of the recurrent weights."""
    n, length, hid = dh_out.shape
    dx, du = np.empty((n, length, 4 * hid)), np.zeros_like(u)
    dh, dc = np.zeros((n, hid)), np.zeros((n, hid))
    for t in range(length - 1, -1, -1):
        before, c_before, i, f, o, g, th = kept[t]
        dh = dh + dh_out[:, t]
        dc = dc + dh * o * (1 - th**2)
        dz = np.concatenate((dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - g**2)), axis=1)
        dx[:, t] = dz
        du += before.T @ dz
        dh, dc = dz @ u.T, dc * f
    return dx, du


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


class Tagger:
    """Bidirectional character LSTM with CRF transitions."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        s = 1 / np.sqrt(hidden)
        self.p = {"xf": r.normal(0, 0.3, (CODES, 4 * hidden)), "xb": r.normal(0, 0.3, (CODES, 4 * hidden)), "uf": r.normal(0, s, (hidden, 4 * hidden)), "ub": r.normal(0, s, (hidden, 4 * hidden))}
        self.p |= {"v": r.normal(0, s, (2 * hidden, TAGS)), "d": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)), "start": np.zeros(TAGS)}

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        hf, kf = _run(p["xf"][codes], p["uf"])
        hb, kb = _run(p["xb"][codes[:, ::-1]], p["ub"])
        both = np.concatenate((hf, hb[:, ::-1]), axis=2)
        return both @ p["v"] + p["d"], (both, kf, kb)

    def loss_and_gradients(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        p = self.p
        e, (both, kf, kb) = self.emissions(codes)
        n, length, k = e.shape
        trans = p["t"] + _allowed()
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + p["start"]
        for t in range(1, length):
            alpha[:, t] = e[:, t] + _lse(alpha[:, t - 1, :, None] + trans, 1)
        for t in range(length - 2, -1, -1):
            beta[:, t] = _lse(trans + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        log_z = _lse(alpha[:, -1], 1)
        de = np.exp(alpha + beta - log_z[:, None, None])
        dt = np.zeros((k, k))
        for t in range(1, length):
            dt += np.exp(alpha[:, t - 1, :, None] + trans + (e[:, t] + beta[:, t])[:, None, :] - log_z[:, None, None]).sum(axis=0)
        rows, steps = np.arange(n)[:, None], np.arange(length)
        gold = e[rows, steps, tags].sum() + p["start"][tags[:, 0]].sum() + trans[tags[:, :-1], tags[:, 1:]].sum()
        g = {"start": de[:, 0].sum(axis=0) - np.bincount(tags[:, 0], minlength=k)}
        de[rows, steps, tags] -= 1
        np.add.at(dt, (tags[:, :-1], tags[:, 1:]), -1)
        g |= {"t": dt, "d": de.sum(axis=(0, 1)), "v": np.einsum("nth,ntk->hk", both, de)}  # einsum: small products that start no threads
        dboth = de @ p["v"].T
        hid = both.shape[2] // 2
        dxf, g["uf"] = _run_back(dboth[:, :, :hid], kf, p["uf"])
        dxb, g["ub"] = _run_back(dboth[:, ::-1, hid:], kb, p["ub"])
        for name, dx, c in (("xf", dxf, codes), ("xb", dxb, codes[:, ::-1])):
            order = np.argsort(c.ravel(), kind="stable")
            starts = np.flatnonzero(np.concatenate(([True], np.diff(c.ravel()[order]) != 0)))
            g[name] = np.zeros_like(p[name])
            g[name][c.ravel()[order][starts]] = np.add.reduceat(dx.reshape(c.size, -1)[order], starts, axis=0)
        return float((log_z.sum() - gold) / n), {a: b / n for a, b in g.items()}

    def fit(self, examples: list[tuple[str, list[Span]]], steps: int = STEPS, batch: int = BATCH, rate: float = 0.02, seed: int = SEED) -> Tagger:
        """Adam on windows of labelled texts."""
        codes = np.stack([_codes(t.ljust(WINDOW)[:WINDOW]) for t, _ in examples])
        tags = np.zeros_like(codes)
        for row, (_, spans) in enumerate(examples):
            for kind, a, b in spans:
                if b <= WINDOW:
                    tags[row, a:b] = 2 + 2 * KINDS.index(kind)
                    tags[row, a] -= 1
        r = np.random.default_rng(seed)
        m, v = ({a: np.zeros_like(b) for a, b in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            pick = r.integers(0, len(codes), batch)
            _, g = self.loss_and_gradients(codes[pick], tags[pick])
            norm = np.sqrt(sum((x**2).sum() for x in g.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for a, x in g.items():
                x = x * min(1.0, 5 / (norm + 1e-9))
                m[a] = 0.9 * m[a] + 0.1 * x
                v[a] = 0.99 * v[a] + 0.01 * x**2
                self.p[a] = self.p[a] - now * (m[a] / (1 - 0.9**step)) / (np.sqrt(v[a] / (1 - 0.99**step)) + 1e-8)
        return self

    def decode(self, codes: np.ndarray) -> list[list[tuple[str, int, int, float]]]:
        """Per window its best path's spans, each with the mean margin of its tags over outside."""
        e, _ = self.emissions(codes)
        trans = self.p["t"] + _allowed()
        n, length, k = e.shape
        best, back = e[:, 0] + self.p["start"], np.empty((n, length, k), np.int8)
        for t in range(1, length):
            all_ = best[:, :, None] + trans
            back[:, t] = all_.argmax(axis=1)
            best = e[:, t] + all_.max(axis=1)
        path = np.empty((n, length), np.int64)
        path[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        out = []
        for row in range(n):
            spans, a = [], 0
            p = path[row]
            while a < length:
                if p[a] == 0:
                    a += 1
                    continue
                b = a + 1
                while b < length and p[b] == (p[a] - 1) // 2 * 2 + 2:
                    b += 1
                margin = float((e[row, np.arange(a, b), p[a:b]] - e[row, a:b, 0]).mean())
                spans.append((KINDS[(p[a] - 1) // 2], a, b, margin))
                a = b
            out.append(spans)
        return out


def labelled_texts(n: int = 2400, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Labelled texts made by rule: invented prose around plain and disguised personal data, and what resembles it."""
    r = random.Random(seed)
    syllables = "th er on an in re ed nd ha en to it is or es ou le la que de ment pa ch ge sch ung eau ci ar ta".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    digits = lambda k: some("0123456789", k)

    def card(sep: str) -> str:
        d = digits(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def made() -> tuple[str | None, str]:
        name = r.choice([word(), f"{word()}.{digits(2)}", f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}"])
        host = f"{word()}{r.choice(['', digits(1), '-' + word()])}.{r.choice(['com', 'org', 'net', 'de', 'example.com'])}"
        byte = lambda: str(r.randrange(256))
        return r.choice(
            [
                ("email", f"{name}@{host}"),
                ("email", f"{name} @ {host}"),
                ("email", f"{name}@ {host}"),
                ("email", f"{name} @{host}"),
                ("ip", ".".join(byte() for _ in range(4))),
                ("ip", " . ".join(byte() for _ in range(4))),
                ("card", card(r.choice(["", " ", "-"]))),
                ("card", card(r.choice([".", "/", "  "]))),
                ("phone", f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}"),
                ("phone", f"({digits(3)}) {digits(3)}-{digits(4)}"),
                ("phone", f"{digits(3)}-{digits(3)}-{digits(4)}"),
                (None, f'token = "{some("0123456789abcdef", 40)}"'),
                (None, f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"),
                (None, f"{r.randrange(100)}.{r.randrange(100)}"),
                (None, digits(r.randint(1, 6))),
                (None, f"v{r.randrange(9)}.{r.randrange(9)}.{r.randrange(20)}"),
                (None, f"{r.randint(1, 99)}%"),
                (None, f"@{word()}"),
            ]
        )

    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            text += word() + r.choice([" ", " ", " ", ", ", ". ", "\n", " | ", "!! "])
            if r.random() < 0.12:
                kind, value = made()
                if kind:
                    spans.append((kind, len(text), len(text) + len(value)))
                text += value + r.choice([" ", ", ", ". ", "### "])
        out.append((text, spans))
    return out


@lru_cache(maxsize=4)
def trained(n: int = 2400, steps: int = STEPS, seed: int = SEED) -> Tagger:
    return Tagger(seed=seed).fit(labelled_texts(n, seed), steps, seed=seed)


def plausible(kind: str, value: str) -> bool:
    """What an added span must satisfy beyond its tags."""
    digits = "".join(_DIGIT.findall(value))
    if kind == "email":
        left, _, right = value.partition("@")
        return bool(left.strip()) and bool(_HOST.fullmatch(right.strip())) and not re.search(r"\s\S+\s", value.replace("@", " ").strip())
    if kind == "ip":
        parts = re.split(r"\s*\.\s*", value)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search(r"[A-Za-z@]", value)
    return 9 <= len(digits) <= 15 and not re.search(r"[A-Za-z@]", value) and bool(re.search(r"[()\x20.-]", value))


def reconcile(spans: list[tuple[str, int, int, float]]) -> list[Span]:
    """The heaviest set of spans that do not overlap; equal spans of several windows count once, with their best score."""
    best: dict[Span, float] = {}
    for kind, a, b, score in spans:
        best[kind, a, b] = max(score * (b - a), best.get((kind, a, b), 0.0))
    order = sorted(best, key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in order]
    total, take = [0.0], []
    for k, s in enumerate(order):
        before = int(np.searchsorted(ends, s[1], side="right"))
        before = min(before, k)
        with_it = total[before] + best[s]
        take.append((with_it > total[k], before))
        total.append(max(total[k], with_it))
    out, k = [], len(order)
    while k:
        chosen, before = take[k - 1]
        if chosen:
            out.append(order[k - 1])
            k = before
        else:
            k -= 1
    return out[::-1]


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger, batch: int = 512) -> list[list[Span]]:
    """Per text what the tagger adds to its base spans."""
    jobs: list[tuple[int, int]] = []
    for k, text in enumerate(texts):
        starts = {max(0, m.start() // STRIDE * STRIDE - STRIDE * d) for m in _TRIGGER.finditer(text) for d in (0, 1)}
        jobs += [(k, s) for s in sorted(starts)]
    raw: dict[int, list] = {}
    for at in range(0, len(jobs), batch):
        part = jobs[at : at + batch]
        codes = np.stack([_codes(texts[k][s : s + WINDOW].ljust(WINDOW)) for k, s in part])
        for (k, s), spans in zip(part, tagger.decode(codes), strict=True):
            for kind, a, b, score in spans:
                a, b = s + a, min(s + b, len(texts[k]))
                value = texts[k][a:b]
                if not value.strip():
                    continue
                a, b = a + len(value) - len(value.lstrip()), b - (len(value) - len(value.rstrip()))
                whole = (a == 0 or not texts[k][a - 1].isalnum()) and (b == len(texts[k]) or not texts[k][b].isalnum())
                clear = all(b <= x or a >= y for _, x, y in base[k])
                if score >= MIN_SCORE and b > a and whole and clear and plausible(kind, texts[k][a:b]):
                    raw.setdefault(k, []).append((kind, a, b, score))
    return [reconcile(raw.get(k, [])) for k in range(len(texts))]


_TRIGGER = re.compile(TRIGGER)


def find_pii(docs: DataFrame, tagger: Tagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, spans)``, one row per input row: arrays of ``(kind, start, end)`` in code points, end exclusive.

    ``spans`` holds the base ones and those added, by start, then kind. Null and empty texts have none;
    repeated rows and null ids are kept; very long texts are read whole, window by window; an empty table
    gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # a few thousand numbers
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            at = np.flatnonzero(np.asarray(pc.match_substring_regex(texts, TRIGGER)))
            some = texts.take(pa.array(at)).to_pylist()
            base = [base_spans(t) for t in some]
            more = added_spans(some, base, model)
            full: list[list] = [[] for _ in range(batch.num_rows)]
            every: list[list] = [[] for _ in range(batch.num_rows)]
            for i, b, m in zip(at.tolist(), base, more, strict=True):
                full[i] = [dict(zip(("kind", "start", "end"), s, strict=True)) for s in b]
                every[i] = [dict(zip(("kind", "start", "end"), s, strict=True)) for s in sorted(b + m, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(full, kind), pa.array(every, kind)], names=["doc_id", "base", "spans"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    spans = "array<struct<kind:string,start:long,end:long>>"
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, base {spans}, spans {spans}")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_pii``: counts are of the base spans, ``n_added`` of the others."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    )


def digest(spans: list[Span]) -> str:
    return hashlib.sha256(written(spans).encode()).hexdigest()
