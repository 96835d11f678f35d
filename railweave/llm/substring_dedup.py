"""Removal of repeated word windows, with a count-min prefilter.

A window is `width` consecutive words of one text.  A word goes if it lies in a
window whose word sequence also starts in a text with a smaller doc_id.

First pass: every window is represented by its anchor, the least-hashed run of
`ANCHOR` words in it (equal windows have equal anchors, neighbouring windows
mostly share one).  Each partition sketches its anchors, at most once a text, in
a count-min sketch; the merged counters overestimate in how many texts an anchor
lies.  The sketch's length follows the amount of text up to `SKETCH_LIMIT`
bytes, beyond which it lets more windows through but still loses none.  Second
pass: windows whose anchor is estimated to lie in two texts or more are grouped
by 96 bits, their own hash and half of their anchor's, for the smallest doc_id.
Chunks of a partition settle repeats among their own texts, so a passage that a
third of all texts hold reaches its group once per chunk.

Defined results: null and wordless texts have no words and keep none; texts
shorter than a window stay whole.  Windows that repeat within one text only stay.
Rows that share a doc_id count as one text for "smaller", but each loses only its own
words.  Rows without doc_id lose nothing and take nothing.  Columns other than
doc_id and text pass through strip_repeats() untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import fresh, in_groups
from .text import Words, mix, slices, texts

ANCHOR = 16
SKETCH_LEAST = 1 << 16
SKETCH_LIMIT = 1 << 26
#: Windows that a chunk settles at once.
CHUNK = 2_000_000
_ROWS = 2
_SEGMENT = 1 << 16


def _windows(w: Words, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, anchor hash, text and first word of every window."""
    h, at = w.runs(width)
    if not len(h):
        z = np.zeros(0, np.int64)
        return h, h, z, z
    k = min(ANCHOR, width)
    grams, g_at = w.runs(k)
    by = np.full(len(w.hashes) + 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    by[g_at] = grams
    span = width - k + 1
    # Sliding minimum by doubling: windows of one text never reach past it.
    low, have = by, 1
    while 2 * have <= span:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    anchors = np.minimum(low[at], low[at + span - have])
    return h, anchors, np.searchsorted(w.first, at, side="right") - 1, at


def _slots(anchors: np.ndarray, length: int) -> list[np.ndarray]:
    return [(mix(anchors, 11 + r) & np.uint64(length - 1)).astype(np.int64) for r in range(_ROWS)]


def _sketch(docs: DataFrame, width: int, length: int) -> np.ndarray:
    """Merged counters, cut off at 2, of the texts that hold each anchor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            rows: dict[str, list] = {"segment": [], "once": [], "twice": []}
            for r, slot in enumerate(_slots(np.concatenate(held), length)):
                slot, n = np.unique(slot + r * length, return_counts=True)
                cut = np.searchsorted(slot, np.arange(r * length, (r + 1) * length + 1, _SEGMENT))
                for i in range(len(cut) - 1):
                    if cut[i + 1] > cut[i]:
                        s, m = slot[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]]
                        rows["segment"].append((r * length) // _SEGMENT + i)
                        rows["once"].append((s[m == 1] % _SEGMENT).astype(np.uint16).tobytes())
                        rows["twice"].append((s[m > 1] % _SEGMENT).astype(np.uint16).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(rows["segment"], pa.int32()), pa.array(rows["once"], pa.binary()), pa.array(rows["twice"], pa.binary())], names=list(rows))

        held, size = [], 0
        for batch in batches:
            column = texts(batch)
            for a, b in slices(column):
                _, anchors, text, _ = _windows(Words(column.slice(a, b - a)), width)
                if len(anchors):
                    new = np.ones(len(anchors), dtype=bool)
                    new[1:] = (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])
                    text, anchors = text[new], anchors[new]
                    once = np.unique(anchors ^ mix(text.astype(np.uint64), 5), return_index=True)[1]
                    held.append(anchors[once])
                    size += len(once)
            if size > CHUNK:
                yield out(held)
                held, size = [], 0
        if size:
            yield out(held)

    def merge(table: pa.Table) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_SEGMENT, dtype=np.int64)
        for name, by in (("once", 1), ("twice", 2)):
            for x in table.column(name):
                n += by * np.bincount(np.frombuffer(x.as_py(), dtype=np.uint16), minlength=_SEGMENT)
        bits = np.packbits(n > 1)
        yield pa.RecordBatch.from_arrays([pa.array([table.column("segment")[0].as_py()], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["segment", "bits"])

    merged = in_groups(docs.select("text").mapInArrow(count, "segment int, once binary, twice binary"), ["segment"], merge, "segment int, bits binary").toArrow()
    out = np.zeros(_ROWS * length // 8, dtype=np.uint8)
    for s, bits in zip(merged.column(0).to_pylist(), merged.column(1).to_pylist(), strict=True):
        out[s * _SEGMENT // 8 : (s + 1) * _SEGMENT // 8] = np.frombuffer(bits, dtype=np.uint8)
    return out


def _ranges(text: np.ndarray, at: np.ndarray, docs: np.ndarray, rows: np.ndarray, width: int) -> pa.RecordBatch:
    """Window starts of texts, by text and start, as ranges of covered words."""
    order = np.lexsort((at, text))
    text, at = text[order], at[order]
    cut = np.ones(len(text), dtype=bool)
    cut[1:] = (text[1:] != text[:-1]) | (at[1:] - at[:-1] > width)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(text)) - 1
    return pa.RecordBatch.from_arrays([pa.array(docs[text[first]]), pa.array(rows[text[first]]), pa.array(at[first].astype(np.int32)), pa.array((at[last] + width).astype(np.int32))], names=["doc_id", "row", "a", "b"])


_RANGE = "doc_id long, row long, a int, b int"
_PACKED = {"hashes": np.uint64, "anchors": np.uint32, "texts": np.uint32, "starts": np.int32, "docs": np.int64, "rows": np.int64}


def _least(hashes: np.ndarray, anchors: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by window and doc_id, and which windows in it start in their smallest doc_id."""
    order = np.lexsort((doc, anchors, hashes))
    h, k, d = hashes[order], anchors[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
    return order, d == d[np.flatnonzero(new)][np.cumsum(new) - 1]


def repeated_ranges(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, row, a, b): word ranges [a, b) to remove from the text of a doc_id whose hash is row; ranges may overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_key().alias("row")).filter("doc_id is not null")
    chars = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    length = SKETCH_LEAST
    while length < SKETCH_LIMIT and length < chars // 12:
        length *= 2
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, width, length))
    buckets = max(8, int(chars // 25_000_000))

    def settle(held: dict[str, list]) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
        x = {k: np.concatenate(v) for k, v in held.items()}
        order, mine = _least(x["hashes"], x["anchors"], x["docs"][x["texts"]])
        gone = _ranges(x["texts"][order[~mine]], x["starts"][order[~mine]], x["docs"], x["rows"], width) if not mine.all() else None
        mine = order[mine]
        b = (mix(x["anchors"][mine].astype(np.uint64), 21) % np.uint64(buckets)).astype(np.int64)
        deal = np.argsort(b, kind="stable")
        mine, cut = mine[deal], np.searchsorted(b[deal], np.arange(buckets + 1))
        out: dict[str, list] = {"bucket": [], **{k: [] for k in _PACKED}}
        for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            pick = mine[cut[i] : cut[i + 1]]
            own, local = np.unique(x["texts"][pick], return_inverse=True)
            part = {"hashes": x["hashes"][pick], "anchors": x["anchors"][pick], "texts": local, "starts": x["starts"][pick], "docs": x["docs"][own], "rows": x["rows"][own]}
            out["bucket"].append(i)
            for k, t in _PACKED.items():
                out[k].append(part[k].astype(t).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in _PACKED)], names=list(out)), gone

    def emit(packed: pa.RecordBatch, gone: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        names = ["bucket", *_PACKED, "doc_id", "row", "a", "b"]
        n = packed.num_rows
        yield pa.RecordBatch.from_arrays([*packed.columns, *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=names)
        if gone is not None:
            # Settled ranges travel with the buckets, dealt by their text.
            b = pa.array((gone.column(0).to_numpy() % buckets).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b, *(pa.nulls(gone.num_rows, pa.binary()) for _ in _PACKED), *gone.columns], names=names)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sketch.value
        held: dict[str, list] = {k: [] for k in _PACKED}
        size = known = 0
        for batch in batches:
            column = texts(batch)
            doc_ids, rows = (batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in ("doc_id", "row"))
            for a, b in slices(column):
                w = Words(column.slice(a, b - a))
                h, anchors, text, at = _windows(w, width)
                if not len(h):
                    continue
                often = np.ones(len(h), dtype=bool)
                for r, slot in enumerate(_slots(anchors, length)):
                    slot += r * length
                    often &= ((bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1).astype(bool)
                if often.any():
                    of = text[often]
                    for k, v in (("hashes", h[often]), ("anchors", anchors[often].astype(np.uint32)), ("texts", of + known), ("starts", at[often] - w.first[of]), ("docs", doc_ids[a:b]), ("rows", rows[a:b])):
                        held[k].append(v)
                    size += len(of)
                    known += b - a
                if size > CHUNK:
                    yield from emit(*settle(held))
                    held, size, known = {k: [] for k in _PACKED}, 0, 0
        if size:
            yield from emit(*settle(held))

    def group(table: pa.Table) -> Iterator[pa.RecordBatch]:
        known = table.filter(table.column("doc_id").is_valid()).select(["doc_id", "row", "a", "b"]).combine_chunks()
        yield from known.to_batches()
        held = table.filter(table.column("hashes").is_valid())
        if not held.num_rows:
            return
        parts = {k: [np.frombuffer(v.as_buffer(), dtype=t) for v in held.column(k)] for k, t in _PACKED.items()}
        base = np.cumsum([0, *map(len, parts["docs"][:-1])])
        parts["texts"] = [t + int(b) for t, b in zip((t.astype(np.int64) for t in parts["texts"]), base, strict=True)]
        x = {k: np.concatenate(v) for k, v in parts.items()}
        order, mine = _least(x["hashes"], x["anchors"], x["docs"][x["texts"]])
        if not mine.all():
            gone = order[~mine]
            yield _ranges(x["texts"][gone], x["starts"][gone].astype(np.int64), x["docs"], x["rows"], width)

    chosen = docs.mapInArrow(select, "bucket int, " + ", ".join(f"{k} binary" for k in _PACKED) + f", {_RANGE}")
    return in_groups(chosen, ["bucket"], group, _RANGE)


def row_key() -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _cut(batch: pa.RecordBatch, ranges: str) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """Of each row: number of words, which of them stay, and the words."""
    column = texts(batch)
    gone = batch.column(batch.schema.get_field_index(ranges)).to_pylist()
    for a, b in slices(column):
        w = Words(column.slice(a, b - a))
        data = w.data.tobytes()
        for i in range(b - a):
            lo, hi = int(w.first[i]), int(w.first[i + 1])
            stay = np.ones(hi - lo, dtype=bool)
            for r in gone[a + i] or ():
                stay[r["a"] : r["b"]] = False
            at = np.flatnonzero(stay) + lo
            yield hi - lo, stay, [data[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]


def _with_ranges(docs: DataFrame, width: int) -> tuple[DataFrame, str]:
    """docs with the ranges to remove in a column of the name that is returned."""
    key, row, ranges = (fresh(c, docs.columns) for c in ("gone_id", "gone_row", "gone"))
    found = repeated_ranges(docs, width).groupBy(F.col("doc_id").alias(key), F.col("row").alias(row)).agg(F.collect_set(F.struct("a", "b")).alias(ranges))
    return docs.join(found, (docs["doc_id"] == found[key]) & (row_key() == found[row]), "left").drop(key, row), ranges


def substring_digest(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, sha = [], [], []
            for words, stay, kept in _cut(batch, ranges):
                n.append(words)
                removed.append(words - int(stay.sum()))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows, ranges = _with_ranges(docs, width)
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def strip_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """docs with repeated words out of their texts.

    Texts that lose nothing stay as they are; of others, the kept words are
    joined by one space.  All columns stay, n_chars follows the text if present.
    """
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(batch.schema.get_field_index("text")).to_pylist()
            new = [b" ".join(kept).decode() if not stay.all() else t for t, (_, stay, kept) in zip(old, _cut(batch, ranges), strict=True)]
            cols = []
            for c in names:
                col = batch.column(batch.schema.get_field_index(c))
                if c == "text":
                    col = pa.array(new, pa.string())
                elif c == "n_chars":
                    col = pa.array([k if t is None else len(t) for t, k in zip(new, col.to_pylist(), strict=True)], pa.int64()).cast(col.type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows, ranges = _with_ranges(docs, width)
    return rows.mapInArrow(run, schema)


def substring_sql() -> str:
    """DuckDB SQL for substring_digest() with 50 words over the table documents."""
    return """
WITH words AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
    SELECT doc_id, k, md5(array_to_string(w[k:k + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM words WHERE len(w) >= 50)
), gone AS (
    SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS first FROM windows) WHERE first < doc_id
), each AS (
    SELECT e.doc_id, e.j, e.word, max(g.k) OVER (PARTITION BY e.doc_id ORDER BY e.j ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS out
    FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM words) e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.k = e.j
), kept AS (
    SELECT doc_id, count(*) FILTER (out) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT out), '') AS text FROM each GROUP BY doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id"""
