"""Toxicity by a factorisation machine over hashed terms.

A text's terms are its distinct lower-cased words without ASCII marks, hashed
into `SLOTS` slots.  The machine scores
``b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)``: besides each term's
weight it learns what pairs of terms say together, which additive weights miss.

Training is bounded: at most `SAMPLE` labelled texts, those with the least hash
of their doc_id, outside the held-out share.  Of their slots, the `TERMS` with
the strongest evidence (z score of the log odds) become features.  So do both members
of pairs that say together what neither says alone: among the `PAIRED` most frequent
slots, pairs whose share of toxic texts lies `PAIR_Z` standard errors off what the
members' log odds add up to, and as many off either member's own.
Every other slot is left out of the model.  Weights are fitted with mini-batches and AdaGrad from a fixed seed, so equal input gives
equal scores.  Scoring is one pass over all texts; the model (under 1 MB) is
broadcast.

Defined results: null and empty texts have no terms and get the score of the bias
alone; repeated words count once; a label other than 0 and 1 or a null is not
learned from; repeated labels of one text count each.  Without labels of both
kinds every score is the share of positives (0 if there are none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import Words, slices, texts

SLOTS = 1 << 20
SAMPLE = 12_000
TERMS = 4096
FACTORS = 4
#: Slots whose pairs are looked at, and how clear a pair must be.
PAIRED = 768
PAIR_Z = 12.0
THRESHOLD = 0.3


class Machine:
    """Weights by feature; feature[slot] is -1 for slots that say nothing."""

    def __init__(self, feature: np.ndarray, bias: float, w: np.ndarray, v: np.ndarray):
        self.feature, self.bias, self.w, self.v = feature, bias, w, v

    def scores(self, doc: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts, whose distinct slots are given by text."""
        f = self.feature[slot]
        doc, f = doc[f >= 0], f[f >= 0]
        linear = np.bincount(doc, self.w[f], n)
        s = np.stack([np.bincount(doc, self.v[f, k], n) for k in range(self.v.shape[1])])
        q = np.bincount(doc, (self.v[f] ** 2).sum(axis=1), n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + ((s**2).sum(axis=0) - q) / 2, -30, 30)))


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot), distinct, of a slice of texts."""
    w = Words(column, lower=True, bare=True)
    doc = np.repeat(np.arange(len(column)), w.counts())
    key = np.unique(doc.astype(np.uint64) << np.uint64(20) | w.hashes >> np.uint64(44))
    return (key >> np.uint64(20)).astype(np.int64), (key & np.uint64(SLOTS - 1)).astype(np.int64)


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the doc_id as text leaves this remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def _paired(doc: np.ndarray, slot: np.ndarray, label: np.ndarray, df: np.ndarray, pos: float) -> np.ndarray:
    """Slots that matter only beside another one."""
    n = len(label)
    often = np.flatnonzero((df >= 20) & (df <= 0.9 * n))
    often = often[np.argsort(-df[often], kind="stable")[:PAIRED]]
    if len(often) < 2:
        return often[:0]
    at = np.full(SLOTS, -1, dtype=np.int32)
    at[often] = np.arange(len(often))
    doc, col = doc[at[slot] >= 0], at[slot][at[slot] >= 0]
    both, hit = (np.zeros((len(often), len(often)), dtype=np.float32) for _ in range(2))
    cut = np.searchsorted(doc, np.arange(0, n + 2048, 2048))
    for k in range(len(cut) - 1):
        x = np.zeros((2048, len(often)), dtype=np.float32)
        x[doc[cut[k] : cut[k + 1]] - 2048 * k, col[cut[k] : cut[k + 1]]] = 1
        both += x.T @ x
        y = x[: max(0, min(2048, n - 2048 * k))][label[2048 * k : 2048 * (k + 1)] > 0]
        hit += y.T @ y
    base = np.log(pos / (n - pos))
    # If two terms add up, the log odds of texts with both are the sum of what each shifts.
    single = np.log((np.diag(hit) + 0.5) / (np.diag(both - hit) + 0.5)) - base
    p = 1 / (1 + np.exp(-np.clip(base + single[:, None] + single[None, :], -30, 30)))
    # Words that mostly come together do not add up either; the pair must also differ from each member.
    own = np.diag(hit) / np.diag(both)
    z = np.minimum.reduce([np.abs(hit - both * q) / np.sqrt(both * q * (1 - q) + 1) for q in (p, own[:, None], own[None, :])])
    z[both < 20] = 0
    np.fill_diagonal(z, 0)
    return often[(z > PAIR_Z).any(axis=1)]


def fit(doc: np.ndarray, slot: np.ndarray, label: np.ndarray, rounds: int = 12, rate: float = 0.1, decay: float = 2e-3, seed: int = 1) -> Machine:
    n, pos = len(label), float(label.sum())
    feature = np.full(SLOTS, -1, dtype=np.int32)
    share = pos / n if n else 0.0
    if not 0 < share < 1:
        return Machine(feature, 30.0 if share else -30.0, np.zeros(1), np.zeros((1, FACTORS)))
    df = np.bincount(slot, minlength=SLOTS)
    hit = np.bincount(slot, label[doc], SLOTS)
    odds = np.log((hit + 0.5) / (pos - hit + 0.5)) - np.log((df - hit + 0.5) / (n - pos - df + hit + 0.5))
    z = np.abs(odds) / np.sqrt(1 / (hit + 0.5) + 1 / (pos - hit + 0.5) + 1 / (df - hit + 0.5) + 1 / (n - pos - df + hit + 0.5))
    z[df < 5] = 0
    chosen = np.argsort(-z, kind="stable")[:TERMS]
    chosen = np.union1d(chosen[z[chosen] > 3], _paired(doc, slot, label, df, pos))
    feature[chosen] = np.arange(len(chosen))
    f = feature[slot]
    doc, f = doc[f >= 0], f[f >= 0]
    first = np.searchsorted(doc, np.arange(n + 1))
    rng = np.random.default_rng(seed)
    m = max(1, len(chosen))
    w, v, b = np.zeros(m), rng.normal(0, 0.02, (m, FACTORS)), float(np.log(share / (1 - share)))
    gw, gv, gb = np.full(m, 1e-6), np.full((m, FACTORS), 1e-6), 1e-6
    for _ in range(rounds):
        order = rng.permutation(n)
        for a in range(0, n, 128):
            rows = order[a : a + 128]
            lens = first[rows + 1] - first[rows]
            row = np.repeat(np.arange(len(rows)), lens)
            x = f[np.repeat(first[rows], lens) + np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens)]
            s = np.stack([np.bincount(row, v[x, k], len(rows)) for k in range(FACTORS)], axis=1)
            y = b + np.bincount(row, w[x], len(rows)) + ((s**2).sum(axis=1) - np.bincount(row, (v[x] ** 2).sum(axis=1), len(rows))) / 2
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[rows]) / len(rows)
            dw = np.bincount(x, g[row], m) + decay * w / len(rows)
            dv = np.stack([np.bincount(x, g[row] * (s[row, k] - v[x, k]), m) for k in range(FACTORS)], axis=1) + decay * v / len(rows)
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            w -= rate * dw / np.sqrt(gw)
            v -= rate * dv / np.sqrt(gv)
            b -= rate * g.sum() / np.sqrt(gb)
    return Machine(feature, b, w, v)


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """Fits the machine on a bounded sample of docs(doc_id, text) by labels(doc_id, toxic)."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(~held_out(F.col("doc_id"), 4, 2))
    known = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "toxic").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, toxic = texts(batch), batch.column(batch.schema.get_field_index("toxic"))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for a, b in slices(column):
                doc, slot = _terms(column.slice(a, b - a))
                cut = np.searchsorted(doc, np.arange(b - a + 1))
                packed = [slot[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), toxic.slice(a, b - a), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "slots"])

    # At most `sample` small rows, so their side is broadcast.
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known), "doc_id")
    got = rows.mapInArrow(run, "doc_id long, toxic int, slots binary").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending"), ("slots", "ascending")])
    slots = [np.frombuffer(x, dtype=np.int32) for x in got.column("slots").to_pylist()]
    doc = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    return fit(doc, np.concatenate(slots).astype(np.int64) if slots else np.zeros(0, np.int64), np.array(got.column("toxic").to_pylist(), dtype=float))


def toxicity(docs: DataFrame, machine: Machine, keep: bool = False, name: str = "score") -> DataFrame:
    """docs(doc_id, text) with score (0 to 1); keep: all columns of docs stay, else doc_id and score.

    name: of the score's column, which replaces one of docs.
    """
    held = docs.sparkSession.sparkContext.broadcast(machine)
    docs = docs.drop(name)
    docs = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = [c for c in docs.columns if keep or c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            column = texts(batch)
            for a, b in slices(column):
                p = model.scores(*_terms(column.slice(a, b - a)), b - a)
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(n)) for n in names), pa.array(p)], names=[*names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")


def toxicity_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = toxicity(docs, learn(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
