"""SentencePiece encoding and decoding over a lattice of pieces.

A text is cut into words at the word mark; of each distinct word, substrings up
to the longest piece are looked up in the piece table, which gives the edges of its
lattice, and a fold over its positions keeps the best path.  For
unigram models "best" is the highest sum of scores (Viterbi).  The scores of BPE
models are merge ranks, and their highest sum is *not* the library's result.
There the fold admits an edge only behind the edge whose piece it would not have
been merged with: a sequence of pieces is the BPE result exactly if each pair of
neighbours is the BPE result of the two joined.  Such a path is unique; the fold
tries long edges first and leaves a position for good when no edge fits.  Runs of
word marks, whose pieces share one score, and words over `LONGEST` characters (texts
without blanks) are merged directly, by a heap.

Lattices live in each Python worker: a bounded memory of words, filled as words
appear.  The relational form (exploded substrings, shuffled by word, joined back
to 27 million words per 0.1 GB) moves several times the input; see the README.

The model's path is a parameter, read by the driver only; the pieces (bounded by
the vocabulary) are broadcast.  Only models with the identity normaliser are taken.

Defined results: null and empty texts have no ids and decode to "".  Characters
without a piece become byte pieces if the model has them, else its unknown piece.
U+2581 in a text is a word mark and decodes to a space.  Other columns pass
through untouched; columns named ids, n_ids or round_trip are replaced.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that a worker remembers before it starts afresh; longer words are not remembered.
MEMORY = 300_000
LONGEST = 64
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class Pieces:
    """A piece table and its lattice fold."""

    def __init__(self, names: list[str], scores: list[float], kinds: list[str], bpe: bool, prefix: bool):
        self.bpe, self.prefix = bpe, prefix
        self.table = {p: i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if k == "piece"}
        self.scores = scores
        self.starts = {p[:k]: -1 for p in self.table for k in range(1, len(p))} | self.table
        self.unknown = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(names, kinds, strict=True)) if k == "byte"}
        lift = lambda p, k: bytes([int(p[1:-1], 16)]) if k == "byte" else p.replace(MARK, " ").encode() if k == "piece" else " ⁇ ".encode() if k == "unknown" else b""
        self.texts = [lift(p, k) for p, k in zip(names, kinds, strict=True)]
        self.lowest = min((scores[i] for i in self.table.values()), default=0.0) - 10.0
        #: Whether BPE keeps a piece as its own behind another ("": at a word's start).
        self.pairs: dict[str, dict[str, bool]] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def read(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if len(spec.precompiled_charsmap) or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models with the identity normaliser are taken")
        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        kind = lambda i: "byte" if sp.is_byte(i) else "unknown" if sp.is_unknown(i) else "control" if sp.is_control(i) else "unused" if sp.is_unused(i) else "piece"
        return cls([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids], [kind(i) for i in ids], model.trainer_spec.model_type == 2, spec.add_dummy_prefix)

    def merged(self, word: str) -> list[str]:
        """BPE of a word by merges: highest score first, then leftmost."""
        table, scores = self.table, self.scores
        part = list(word)
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(-scores[i], k, part[k], part[k + 1]) for k in range(len(part) - 1) if (i := table.get(part[k] + part[k + 1])) is not None]
        heapify(heap)
        while heap:
            _, k, a, b = heappop(heap)
            n = after[k]
            if part[k] != a or n >= len(part) or part[n] != b or not a:
                continue
            part[k], part[n] = a + b, ""
            after[k] = after[n]
            if after[k] < len(part):
                before[after[k]] = k
            for x in (before[k], k):
                if x >= 0 and after[x] < len(part) and (i := table.get(part[x] + part[after[x]])) is not None:
                    heappush(heap, (-scores[i], x, part[x], part[after[x]]))
        return [p for p in part if p]

    def edges(self, word: str, i: int) -> list[int]:
        """Ends of the lattice's edges from position i, shortest first."""
        starts, out = self.starts, []
        for j in range(i + 1, len(word) + 1):
            k = starts.get(word[i:j])  # None: no piece starts so; -1: only longer pieces do
            if k is None:
                break
            if k >= 0:
                out.append(j)
        if not out or out[0] != i + 1:
            out.insert(0, i + 1)  # a character without a piece
        return out

    def fold(self, word: str) -> list[str]:
        """Pieces of one word: the path that the fold over its lattice leaves."""
        if not self.bpe:
            return self.best(word)
        if MARK * 2 in word or len(word) > LONGEST:
            return self.merged(word)
        # A valid path to a position is the BPE result of what lies before it, so a
        # position from which no edge fits lies on no path and is left for good.
        n, i, last, pairs = len(word), 0, "", self.pairs
        path: list[tuple[int, str, list[int]]] = []
        ends, dead = self.edges(word, 0), set()
        while i < n:
            known = pairs.get(last)
            if known is None:
                known = pairs[last] = {}
            while ends:
                j = ends.pop()
                if j in dead:
                    continue
                p = word[i:j]
                ok = known.get(p)
                if ok is None:
                    ok = known[p] = self.merged(last + p) == ([last, p] if last else [p])
                if ok:
                    path.append((i, last, ends))
                    i, last = j, p
                    ends = self.edges(word, i) if i < n else []
                    break
            else:
                if not path:
                    return self.merged(word)
                dead.add(i)
                i, last, ends = path.pop()
        return [p for _, p, _ in path[1:]] + ([last] if n else [])

    def best(self, word: str) -> list[str]:
        """Viterbi: the path with the highest sum of scores."""
        n = len(word)
        into: list = [None] * (n + 1)
        cost = [0.0] + [float("-inf")] * n
        for i in range(n):
            for j in self.edges(word, i):
                k = self.table.get(word[i:j])
                c = cost[i] + (self.lowest if k is None else self.scores[k])
                if c > cost[j]:
                    into[j], cost[j] = i, c
        out, j = [], n
        while j > 0:
            out.append(word[into[j] : j])
            j = into[j]
        return out[::-1]

    def ids(self, word: str) -> bytes:
        """Ids of one word as packed 32-bit numbers."""
        out = array("i")
        for p in self.fold(word):
            i = self.table.get(p)
            if i is not None:
                out.append(i)
            elif self.byte:
                out.extend(self.byte[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        memory = self.words
        if len(memory) > MEMORY:
            # Words seen since the last turn stay within reach for one more.
            self.older, self.words = memory, {}
            memory = self.words
            if sum(map(len, self.pairs.values())) > MEMORY:
                self.pairs.clear()
        words = _WORDS.findall((MARK if self.prefix else "") + text.replace(" ", MARK))
        out = list(map(memory.get, words))
        if None in out:
            older = self.older
            for k, x in enumerate(out):
                if x is None:
                    w = words[k]
                    out[k] = x = memory.get(w) or older.get(w) or self.ids(w)
                    if len(w) <= LONGEST:
                        memory[w] = x
        return b"".join(out)

    def decode(self, ids: bytes | list[int]) -> str:
        if isinstance(ids, bytes):
            ids = array("i", ids)
        text = b"".join(map(self.texts.__getitem__, ids))
        return (text[1:] if self.prefix and text[:1] == b" " else text).decode(errors="replace")


def _held(spark, model: str):
    return spark.sparkContext.broadcast(Pieces.read(model))


def encode_texts(docs: DataFrame, model: str = MODEL, check: bool = False) -> DataFrame:
    """docs with ids array<int> and n_ids (and round_trip: decoding gives the text back)."""
    docs = docs.drop("ids", "n_ids", "round_trip")
    held = _held(docs.sparkSession, model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for a in range(0, batch.num_rows, 500):
                rows = batch.slice(a, 500)
                found = rows.column(at).to_pylist()
                packed = [pieces.encode(t) for t in found]
                sizes = np.array([len(p) // 4 for p in packed], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
                cols = [rows.column(rows.schema.get_field_index(n)) for n in names] + [ids, pa.array(sizes)]
                if check:
                    cols.append(pa.array([pieces.decode(p) == (t or "") for p, t in zip(packed, found, strict=True)]))
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "ids", "n_ids", *["round_trip"] * check])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, ids array<int>, n_ids long" + ", round_trip boolean" * check)


def decode_ids(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """rows with text, decoded from ids array<int>."""
    rows = rows.drop("text")
    held = _held(rows.sparkSession, model)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held.value
        for batch in batches:
            found = [pieces.decode(x or []) for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(found, pa.string())], names=[*names, "text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, text string")


def piece_query(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, n_ids, round_trip) of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode_texts(docs, model, check=True).drop("text")
