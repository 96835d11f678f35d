"""Language by prediction by partial matching over bytes.

For each language a context tree of order `ORDER` is counted over the classes of
its training bytes (letters without case, white space, digits, other ASCII, and
`HIGH` classes of bytes over 127).  A symbol's code length is exact PPM: method C
escapes, with exclusion of the symbols that a longer context has already offered,
down to a uniform order -1.  Counts are frozen after training, so the code length
of a symbol depends on its context alone and the trees unfold into one table per
language; scoring adds up table entries over all bytes of a text, and the shortest
code wins.  The score is the winner's share of the likelihood, equal priors.

Training is bounded: at most `SAMPLE` whole texts of each language, those with
the least hash of their doc_id; every language is learned.  The tables (classes **
(ORDER + 1) floats a language) are broadcast for `BLOCK` languages at a time: texts
are scored by one block after the other, and written with the best so far between.

Defined results: null texts and texts without a letter are `und` with score 0;
ties go to the language first in order; with nothing to learn from all are `und`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written
from .text import texts
from .toxicity import held_out

ORDER = 3
HIGH = 11
SAMPLE = 300
#: Languages whose tables are in memory together.
BLOCK = 16
CLASSES = 29 + HIGH

_CLASS = np.full(256, 28, dtype=np.int32)
_CLASS[[0x20, *range(9, 14)]] = 0
for _i in range(26):
    _CLASS[65 + _i] = _CLASS[97 + _i] = 1 + _i
_CLASS[48:58] = 27
_CLASS[128:] = 29 + np.arange(128, 256) % HIGH


def _codes(text: bytes) -> np.ndarray:
    """Table index of each byte behind its ORDER predecessors (white space before the start)."""
    c = np.concatenate([np.zeros(ORDER, np.int32), _CLASS[np.frombuffer(text, dtype=np.uint8)]])
    n = len(text)
    code = c[:n].copy()
    for k in range(1, ORDER + 1):
        code = code * CLASSES + c[k : k + n]
    return code


def table(samples: list[bytes]) -> np.ndarray:
    """Code lengths in bits, by context and symbol."""
    codes = np.concatenate([np.zeros(0, np.int64), *(_codes(s) for s in samples)])
    full = np.bincount(codes, minlength=CLASSES ** (ORDER + 1)).astype(np.float64)
    p = np.full((1, CLASSES), 1.0 / CLASSES)
    for order in range(ORDER + 1):
        n = full.reshape(CLASSES ** (ORDER - order), CLASSES**order, CLASSES).sum(axis=0)
        seen = n > 0
        total, kinds = n.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        lower = np.tile(p, (CLASSES, 1)) if order else p
        rest = np.where(seen, 0.0, lower).sum(axis=1, keepdims=True)
        alone = rest <= 0  # every symbol seen: nothing to escape to
        with np.errstate(invalid="ignore", divide="ignore"):
            direct = n / np.where(alone, total, total + kinds)
            escaped = kinds / (total + kinds) * lower / rest
        p = np.where(total > 0, np.where(seen, direct, escaped), lower)
    return -np.log2(p).astype(np.float32).ravel()


def _known(docs: DataFrame) -> DataFrame:
    """Rows to learn from."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text").filter("lang is not null and doc_id is not null and text is not null").filter(~held_out(F.col("doc_id"), 5, 0))


def languages(docs: DataFrame) -> list[str]:
    """Languages in order, from docs(doc_id, text, lang)."""
    return sorted(r.lang for r in _known(docs).select("lang").distinct().collect())


def learn(docs: DataFrame, langs: list[str], sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """These languages, and their tables side by side, from docs(doc_id, text, lang)."""
    known = _known(docs)
    key = F.md5(F.col("doc_id").cast("string"))
    out = []
    for lang in langs:
        ids = [r.doc_id for r in known.filter(F.col("lang") == lang).select("doc_id").orderBy(key, "doc_id").limit(sample).collect()]
        out.append((lang, set(ids)))
    every = sorted(set().union(*(i for _, i in out))) if out else []
    rows = known.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in every], "doc_id long")), "doc_id").collect() if every else []
    by = {lang: sorted(r.text for r in rows if r.lang == lang) for lang in langs}
    tables = np.stack([table([t.encode() for t in by[lang]]) for lang in langs], axis=1) if langs else np.zeros((1, 0), np.float32)
    return langs, tables


def _compared(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """rows(doc_id, text, lang_pred, bits, weight) with the best of theirs and the model's languages.

    weight is the likelihood of all languages so far over the best one's.
    """
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, tables = held.value
        for batch in batches:
            names, least, weights = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang_pred", "bits", "weight"))
            for k, t in enumerate(texts(batch).cast(pa.large_binary())):
                raw = t.as_py()
                c = _CLASS[np.frombuffer(raw, dtype=np.uint8)] if raw else np.zeros(0, np.int32)
                letter = bool(((c > 0) & (c < 27)).any()) or bool((c > 28).any()) and any(map(str.isalpha, raw.decode(errors="replace")))
                if not langs or not letter:
                    continue
                code = _codes(raw)
                bits = np.zeros(len(langs))
                for a in range(0, len(code), 1 << 16):
                    bits += tables[code[a : a + (1 << 16)]].sum(axis=0, dtype=np.float64)
                best = int(bits.argmin())
                name, low = langs[best], float(bits[best])
                weight = float(np.exp2(np.maximum(low - bits, -1000)).sum())
                if names[k] is not None:
                    before, old = least[k], weights[k]
                    if before <= low:
                        weight = old + weight * 2.0 ** max(before - low, -1000)
                        name, low = names[k], before
                    else:
                        weight += old * 2.0 ** max(low - before, -1000)
                names[k], least[k], weights[k] = name, low, weight
            same = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(names, pa.string()), pa.array(least, pa.float64()), pa.array(weights, pa.float64())], names=["doc_id", "text", "lang_pred", "bits", "weight"])

    return rows.mapInArrow(run, "doc_id long, text string, lang_pred string, bits double, weight double")


def identify(docs: DataFrame, models: Iterable[tuple[list[str], np.ndarray]]) -> DataFrame:
    """(doc_id, lang_pred, score) of docs(doc_id, text), by models of languages in order."""
    none = F.lit(None)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), none.cast("string").alias("lang_pred"), none.cast("double").alias("bits"), none.cast("double").alias("weight"))
    for k, model in enumerate(models):
        out = _compared(written(out) if k else out, model)
    return out.select("doc_id", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.coalesce(1 / F.col("weight"), F.lit(0.0)).alias("score"))


def language_query(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    langs = languages(docs)
    found = identify(docs, (learn(docs, langs[a : a + BLOCK]) for a in range(0, len(langs), BLOCK)))
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")
