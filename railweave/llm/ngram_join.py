"""N-gram Jaccard self-join by a token-group matrix.

Documents are sets of word shingles.  Similar sets are put into groups, so that many
versions of one text fall into few groups although each has tokens of its own; the
matrix holds, for each group, the union of its members' tokens.  For a set Q the
overlap with any member is at most its overlap with the union, so only groups whose
bound reaches the needed overlap are opened and their members compared exactly.

All tokens have one global order: frequent tokens last, else by hash.  Of a
group, only the tokens that can decide the bound are stored: the first
``n - ceil(t n) + k`` of each member; of a query, the first
``n - ceil(2t/(1+t) n) + k``, Q being the smaller set of a pair.  Any pair at or
over the threshold shares at least k(|Q|) of these, so a group with fewer hits
cannot hold a partner, and no link is lost.

Links are found in three rounds, and only links that join two components are looked
for.  First, families (sets with one rarest frequent token, or without frequent tokens
one least-hashed token) are compared block by block, each block together with the
family's leader, its member with the smallest share of infrequent tokens.  Second, the
leaders of families are compared with each other through the matrix.  Third, every set
asks the matrix.  There the main component of a family is one group, however many
families share it, and the other sets of these families are groups of `GROUP`; groups
of one component are not asked for by its own members.

Copies are classes of one member before anything is joined.  A token that many sets
hold is split by askers over several tasks, and its groups are copied to each.

Defined results: null, empty or wordless texts have no set, are linked with
nothing and are their own component; texts with fewer than `width` words have
one shingle, the whole sequence.  Rows that share a doc_id are one node, linked with all
that any of their texts is linked with; each keeps its own n_shingles and class_id.
Rows without doc_id are linked with nothing and have neither component_id nor class_id.
Other columns of the input are not read.  Shingles are compared by 64-bit hashes over
words hashed modulo two primes, whole sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import components, forget, in_groups, written
from .text import mix, shingles, texts

#: Members of a group, or of a block of a larger one.
GROUP = 256
#: Least members of a family whose leader takes part in the second round.
LED = 8
#: Most tokens that the order treats as frequent (8 bytes each are broadcast); a
#: token that finds no room keeps its place by hash, which costs time, not links.
FREQUENT = 1 << 18
#: Askers of one token that meet in a task.
HOT = 200_000
#: Query sets of a block that are compared in one task.
QUERIES = 1024
#: Most bits of the filter over needed documents (64 MB are broadcast).
BITS = 1 << 29
#: Bytes of prefixes that a task deals at once, and cells it looks at.
DEALT = 16_000_000
CELLS = 500_000


def _need(n: np.ndarray | int, num: int, den: int):
    return -((-n * num) // den)


def _hits(n):
    """k of a set of n tokens."""
    return 1 + n // 32


def _reach(n, similarity: float):
    """Lengths of the stored and of the asking prefix of a set of n tokens."""
    t = round(similarity * 1000)
    k = _hits(n)
    return np.minimum(n, n - _need(n, t, 1000) + k), np.minimum(n, n - _need(n, 2 * t, 1000 + t) + k)


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    pair = np.array([mix(s, 1).sum(dtype=np.uint64), mix(s, 2).sum(dtype=np.uint64)], dtype=np.uint64).view(np.int64)
    return int(pair[0]), int(pair[1])


def _frequent(docs: DataFrame, width: int, least: int = 3, total: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent tokens by partition counts (those found `least` times in one chunk), their ranks, rarest first, and counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[np.ndarray]) -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= least
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["token", "n"])

        held, size = [], 0
        for batch in batches:
            for s in shingles(texts(batch), width):
                held.append(s)
                size += len(s)
                if size > 2_000_000:
                    yield out(held)
                    held, size = [], 0
        if size:
            yield out(held)

    found = docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= total)
    rows = found.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
    tokens, n = rows.column("token").to_numpy().view(np.uint64), rows.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], (len(tokens) - order).astype(np.int32), n[order]


def _sets(docs: DataFrame, width: int, similarity: float, frequent, prefix: bool) -> DataFrame:
    """(doc_id, n, k1, k2[, family, rare, tokens]): size, key, group key, infrequent tokens and ordered prefix of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, ranks, _ = frequent.value if prefix else (None, None, None)
        for batch in batches:
            sets = shingles(texts(batch), width)
            n = np.array([len(s) for s in sets], dtype=np.int64)
            keys, family, rare, tokens = [], [], [], []
            for s in sets:
                keys.append(_key(s))
                if prefix:
                    least, few = s, len(s)
                    m = int(_reach(len(s), similarity)[0])
                    if len(common) and len(s):
                        at = np.searchsorted(common, s)
                        at[at == len(common)] = 0
                        hot = common[at] == s
                        s = np.concatenate([s[~hot], s[hot][np.argsort(ranks[at[hot]], kind="stable")]])
                        few -= int(hot.sum())
                        if hot.any():
                            least = s[few:][:1]
                    family.append(int(mix(least, 3).min()) if len(least) else 0)
                    rare.append(few)
                    tokens.append(s[:m].tobytes())
            cols = [batch.column(batch.schema.get_field_index("doc_id")), pa.array(n), *(pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))]
            names = ["doc_id", "n", "k1", "k2"]
            if prefix:
                cols += [pa.array(np.array(family, dtype=np.uint64).view(np.int64)), pa.array(rare, pa.int64()), pa.array(tokens, pa.binary())]
                names += ["family", "rare", "tokens"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, k1 long, k2 long" + ", family long, rare long, tokens binary" * prefix)


def _texts(docs: DataFrame, need: DataFrame) -> DataFrame:
    """need(doc_id, ...) with the texts of that doc_id.

    A bitmap by doc_id, as long as needed up to `BITS`, keeps other texts from the shuffle.
    """
    n = need.count()
    length = 1 << 20
    while length < BITS and length < 16 * n:
        length *= 2
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(length))
    slots = need.select((slot + 1).alias("s")).groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).toArrow()
    bitmap = np.zeros((length // 32768 + 1) * 4096, dtype=np.uint8)
    for b, bits in zip(slots.column("b").to_pylist(), slots.column("bits"), strict=True):
        bitmap[(b - 1) * 4096 : b * 4096] = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            s = batch.column(2).to_numpy()
            keep = ((bits[s >> 3] >> (s & 7).astype(np.uint8)) & 1).astype(bool)
            if keep.any():
                yield batch.select(["doc_id", "text"]).filter(pa.array(keep))

    wanted = docs.select("doc_id", "text", slot.alias("slot")).mapInArrow(run, "doc_id long, text string")
    return need.join(wanted, "doc_id")


class _Union:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _star_edges(union: _Union, nodes: list[int]) -> Iterator[pa.RecordBatch]:
    """Edges to the least node of each component: stars, not chains, so that later rounds have less to shorten."""
    edges = [(d, r) for d in dict.fromkeys(nodes) if (r := union.find(d)) != d]
    if edges:
        a, b = zip(*edges, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


class _Block:
    """Sets of a block, in order of size, by token."""

    def __init__(self, sets: dict[int, np.ndarray]):
        self.nodes = sorted(sets, key=lambda d: (len(sets[d]), d))
        self.sizes = np.array([len(sets[d]) for d in self.nodes], dtype=np.int64)
        tokens = np.concatenate([sets[d] for d in self.nodes]) if sets else np.zeros(0, np.uint64)
        order = np.argsort(tokens, kind="stable")
        owner = np.repeat(np.arange(len(self.nodes), dtype=np.int32), self.sizes)[order]
        tokens = tokens[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        self.tokens, self.owner, self.edge = tokens[first], owner, np.append(first, len(tokens))

    def linked(self, s: np.ndarray, similarity: float) -> np.ndarray:
        """Which members are at or over the threshold with the set s."""
        if not len(self.tokens):
            return np.zeros(len(self.nodes), dtype=bool)
        at = np.searchsorted(self.tokens, s)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == s]
        lo, width = self.edge[at], self.edge[at + 1] - self.edge[at]
        pick = np.repeat(lo - np.cumsum(width) + width, width) + np.arange(int(width.sum()))
        both = np.bincount(self.owner[pick], minlength=len(self.nodes))
        t = round(similarity * 1000)
        return 1000 * both >= t * (len(s) + self.sizes - both)

    def span(self, n: int, similarity: float) -> range:
        """Members of n tokens or more that can reach the threshold with a set of n."""
        lo = int(np.searchsorted(self.sizes, n))
        return range(lo, int(np.searchsorted(self.sizes, n * 1000 // round(similarity * 1000), side="right")))


def _named(table: pa.Table, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and set of each row whose text is the one its key names."""
    k1, k2 = table.column("k1").to_pylist(), table.column("k2").to_pylist()
    for i, s in enumerate(shingles(table.column("text").combine_chunks().fill_null(""), width)):
        if _key(s) == (k1[i], k2[i]):
            yield i, s


def _within(similarity: float, width: int):
    """Edges that join the components among the members of one block."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes = table.column("node").to_pylist()
        sets = {nodes[i]: s for i, s in _named(table, width)}
        block, union = _Block(sets), _Union()
        for d in block.nodes:
            span = [j for j in block.span(len(sets[d]), similarity) if union.find(block.nodes[j]) != union.find(d)]
            if span:
                linked = block.linked(sets[d], similarity)
                for j in span:
                    if linked[j]:
                        union.join(d, block.nodes[j])
        yield from _star_edges(union, block.nodes)

    return run


def _between(similarity: float, width: int):
    """Edges from query sets to the members of an opened block, across components."""

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes, comps, asks = (table.column(x).to_pylist() for x in ("node", "comp", "asks"))
        union, ask, hold = _Union(), {}, {}
        for i, s in _named(table, width):
            (ask if asks[i] else hold)[nodes[i]] = s
            union.join(nodes[i], comps[i])
        block, found = _Block(hold), []
        for d, s in ask.items():
            span = [j for j in block.span(len(s), similarity) if union.find(block.nodes[j]) != union.find(d)]
            if span:
                linked = block.linked(s, similarity)
                for j in span:
                    if linked[j]:
                        union.join(d, block.nodes[j])
                        found += [d, block.nodes[j]]
        yield from _star_edges(union, found)

    return run


_DOC = ("node", "n", "sid", "comp", "gcomp")


def _scatter(buckets: int, similarity: float, frequent, per: int):
    """Prefixes of many sets, dealt by token into one packed row per bucket.

    Of the members of a group that hold a token without asking for it, only the
    smallest and the largest are sent.
    """

    def pack(rows: list[dict], hot: np.ndarray, ways: np.ndarray) -> Iterator[pa.RecordBatch]:
        docs = {k: np.array([r[k] for r in rows], dtype=np.int64) for k in _DOC}
        sid = np.unique(docs["sid"], return_inverse=True)[1]
        parts = [np.frombuffer(r["tokens"], dtype=np.uint64) for r in rows]
        tokens, lens = np.concatenate(parts), np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(rows)), lens)
        rank = np.arange(len(tokens)) - np.repeat(np.cumsum(lens) - lens, lens)
        asks = rank < _reach(docs["n"], similarity)[1][owner]
        order = np.lexsort((docs["n"][owner], sid[owner], tokens))
        tokens, owner, asks = tokens[order], owner[order], asks[order]
        group = sid[owner]
        edge = np.ones(len(tokens) + 1, dtype=bool)
        edge[1:-1] = (tokens[1:] != tokens[:-1]) | (group[1:] != group[:-1])
        ends = edge[1:] | edge[:-1]
        keep = ends | asks
        tokens, owner, asks, ends = tokens[keep], owner[keep], asks[keep], ends[keep]
        salt = np.zeros(len(tokens), dtype=np.uint64)
        if len(hot):
            at = np.searchsorted(hot, tokens)
            at[at == len(hot)] = 0
            many = np.where(hot[at] == tokens, ways[at], 1)
            salt = mix(docs["node"][owner].view(np.uint64), 6) % many.astype(np.uint64)
            # The group of a split token is known to all of its tasks.
            more = np.flatnonzero(ends & (many > 1))
            times = many[more]
            extra = np.repeat(more, times)
            tokens, owner, asks = np.concatenate([tokens, tokens[extra]]), np.concatenate([owner, owner[extra]]), np.concatenate([asks, np.zeros(len(extra), dtype=bool)])
            salt = np.concatenate([salt, (np.arange(len(extra)) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)])
        b = (mix(tokens + salt * np.uint64(0x9E3779B97F4A7C15), 4) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        cut = np.searchsorted(b[order], np.arange(buckets + 1))
        out: dict[str, list] = {"bucket": [], "tokens": [], "owner": [], "docs": []}
        for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            pick = order[cut[i] : cut[i + 1]]
            own, at = np.unique(owner[pick], return_inverse=True)
            out["bucket"].append(i)
            out["tokens"].append(tokens[pick].tobytes())
            out["owner"].append((at.astype(np.uint32) * 2 + asks[pick]).astype(np.uint32).tobytes())
            out["docs"].append(np.stack([docs[k][own] for k in _DOC]).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[k], pa.binary()) for k in ("tokens", "owner", "docs"))], names=list(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, _, counts = frequent.value
        hot, ways = common[counts > per], -(-counts[counts > per] // per)
        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["tokens"]:
                    rows.append(r)
                    size += len(r["tokens"])
                if size > DEALT:
                    yield from pack(rows, hot, ways)
                    rows, size = [], 0
        if rows:
            yield from pack(rows, hot, ways)

    return run


def _gather(similarity: float):
    """Hits of query sets in the unions of foreign groups, for the tokens of one bucket."""
    return lambda table: _bucket_hits(table, similarity)


def _bucket_hits(table: pa.Table, similarity: float) -> Iterator[pa.RecordBatch]:
    tokens, owner, docs, base = [], [], [], 0
    for t, o, d in zip(*(table.column(x) for x in ("tokens", "owner", "docs")), strict=True):
        d = np.frombuffer(d.as_buffer(), dtype=np.int64).reshape(len(_DOC), -1)
        tokens.append(np.frombuffer(t.as_buffer(), dtype=np.uint64))
        owner.append(np.frombuffer(o.as_buffer(), dtype=np.uint32).astype(np.int64) + 2 * base)
        docs.append(d)
        base += d.shape[1]
    node, n, sid, comp, gcomp = np.concatenate(docs, axis=1)
    tokens, owner = np.concatenate(tokens), np.concatenate(owner)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    edge = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1], [True]]))
    size = np.diff(edge)
    keep = np.repeat(size > 1, size)
    if not keep.any():
        return
    asks, own = (owner[keep] & 1).astype(bool), owner[keep] >> 1
    run = np.repeat(np.arange(int((size > 1).sum())), size[size > 1])
    del tokens, owner, keep, order
    # The matrix: each group once per token, with the bounds of its members that hold it.
    names, g = np.unique(sid, return_inverse=True)
    held = np.full(len(names), -1, dtype=np.int64)
    held[g] = gcomp
    cells = run * len(names) + g[own]
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    low, high = (by.reduceat(n[own][order], first) for by in (np.minimum, np.maximum))
    cells = cells[first]
    c_run, c_group = cells // len(names), cells % len(names)
    # Only runs with two groups or more can answer anyone.
    per_run = np.bincount(c_run, minlength=int(run[-1]) + 1)
    ask = asks & (per_run[run] > 1)
    q_run, q_own = run[ask], own[ask]
    lo = np.searchsorted(c_run, q_run)
    width = per_run[q_run]
    found: dict[str, list[np.ndarray]] = {"node": [], "sid": [], "hits": []}
    # Askers in order, so that all hits of one meet.
    order = np.argsort(q_own, kind="stable")
    q_own, lo, width = q_own[order], lo[order], width[order]
    total, a = np.cumsum(width), 0
    while a < len(q_own):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + CELLS, side="right")))
        while b < len(q_own) and q_own[b] == q_own[b - 1]:
            b += 1
        w = width[a:b]
        q = np.repeat(q_own[a:b], w)
        at = np.repeat(lo[a:b] - np.cumsum(w) + w, w) + np.arange(int(w.sum()))
        c = c_group[at]
        ok = (c != g[q]) & (held[c] != comp[q]) & (high[at] >= n[q]) & (similarity * low[at] <= n[q] + 1e-6)
        pairs, hits = np.unique(q[ok] * len(names) + c[ok], return_counts=True)
        found["node"].append(node[pairs // len(names)])
        found["sid"].append(names[pairs % len(names)])
        found["hits"].append(hits)
        a = b
    if found["node"]:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64)) for v in found.values()], names=list(found))


def _asked(ready: DataFrame, tokens: int, similarity: float, frequent, per: int) -> DataFrame:
    """(node, sid): sets of ready and the foreign groups whose bound they reach."""
    buckets = max(8, int(tokens // 800_000))
    dealt = ready.select(*_DOC, "tokens").mapInArrow(_scatter(buckets, similarity, frequent, per), "bucket int, tokens binary, owner binary, docs binary")
    hits = in_groups(dealt, ["bucket"], _gather(similarity), "node long, sid long, hits long").groupBy("node", "sid").agg(F.sum("hits").alias("hits"))
    return hits.join(ready.select("node", "n"), "node").filter(F.col("hits") >= 1 + F.floor(F.col("n") / 32)).select("node", "sid")


def _opened(docs: DataFrame, asked: DataFrame, state: DataFrame, similarity: float, width: int) -> DataFrame:
    """Edges between asked(node, sid) and the members of their groups in state(node, doc_id, k1, k2, sid, block, blocks, comp)."""
    about = state.select("node", "doc_id", "k1", "k2", "comp")
    per = asked.groupBy("sid").agg(F.ceil(F.count("*") / QUERIES).alias("parts"))
    blocks = state.groupBy("sid").agg(F.max("blocks").alias("blocks"))
    places = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    asking = asked.join(per.join(blocks, "sid"), "sid").select("node", "sid", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"), places("blocks").alias("block")).join(about, "node").withColumn("asks", F.lit(True))
    members = state.join(per, "sid").select("node", "sid", places("parts").alias("part"), "block", "doc_id", "k1", "k2", "comp", F.lit(False).alias("asks"))
    every = written(asking.unionByName(members))
    return in_groups(_texts(docs, every), ["sid", "block", "part"], _between(similarity, width), "a long, b long")


def ngram_join(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of docs(doc_id, text).

    class_id is the smallest doc_id with the same set (its own for empty sets);
    component_id the smallest doc_id reachable by links.
    """
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = every.filter("doc_id is not null")
    sc = docs.sparkSession.sparkContext
    frequent = sc.broadcast(_frequent(docs, width))

    sets = _sets(docs, width, similarity, frequent, True).filter("n > 0")
    first = sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("n", "family", "rare", "tokens"), "doc_id").alias("s"))
    reps = written(first.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "doc_id", "s.*"))

    # First round: families, block by block.
    sizes = reps.groupBy("family").agg(F.count("*").alias("members"), F.min_by("node", F.struct(F.col("rare") / F.col("n"), F.col("doc_id"), F.col("node"))).alias("leader"))
    many = F.ceil(F.col("members") / GROUP)
    placed = written(reps.drop("tokens", "rare").join(sizes, "family").select("node", "doc_id", "n", "k1", "k2", "family", "members", "leader", many.alias("many"), F.pmod(F.xxhash64("node"), many).alias("seat")))
    crowd = placed.filter("members > 1")
    name = ["node", "doc_id", "k1", "k2", "family"]
    seats = crowd.select(*name, "seat").unionByName(crowd.filter("node = leader").select(*name, F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("seat"))).distinct()
    edges = written(in_groups(_texts(docs, seats), ["family", "seat"], _within(similarity, width), "a long, b long"))

    # Second round: leaders, each a group of its own.
    own = F.coalesce("root", "node")
    joined = components(edges)
    leaders = placed.filter((F.col("node") == F.col("leader")) & (F.col("members") >= LED)).join(joined.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    leaders = written(leaders.select("node", "doc_id", "n", "k1", "k2", F.col("node").alias("sid"), F.lit(0).cast("long").alias("block"), F.lit(1).cast("long").alias("blocks"), own.alias("comp"), own.alias("gcomp")).join(reps.select("node", "tokens"), "node"))
    tokens = leaders.agg(F.sum(F.octet_length("tokens") / 8)).first()[0] or 0
    if tokens:
        asked = written(_asked(leaders, tokens, similarity, frequent, HOT))
        led = written(_opened(docs, asked, leaders, similarity, width))
        edges = edges.unionByName(led)
        joined = components(edges)

    # Third round: the main component of a family is a group; so are the others of the families that share it.
    state = placed.join(joined.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").withColumn("comp", own).drop("of", "root")
    state = written(state)
    mains = state.groupBy("family", "many", "comp").agg(F.count("*").alias("k")).groupBy("family", "many").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("in_main"))
    pooled = mains.groupBy("main").agg(F.sum("in_main").alias("inside"), F.sum(F.col("all") - F.col("in_main")).alias("outside"), F.sum(F.when(F.col("all") > F.col("in_main"), F.col("many")).otherwise(0)).alias("from"))
    seat = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("seat")
    state = state.join(mains.join(pooled, "main").select("family", "main", "inside", "outside", "from", seat), ["family", "seat"])
    inside = F.col("comp") == F.col("main")
    heap = F.when(inside, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("node"), F.greatest(F.lit(1), F.ceil(F.col("outside") / GROUP))))
    blocks = F.when(inside, F.ceil(F.col("inside") / GROUP)).otherwise(F.lit(1)).cast("long")
    # The rest of one family of one block has been compared with all of it.
    state = written(state.select("node", "doc_id", "n", "k1", "k2", F.xxhash64("main", heap).alias("sid"), F.pmod(F.xxhash64("node", F.lit(7)), blocks).alias("block"), blocks.alias("blocks"), "comp", F.when(inside, F.col("comp")).otherwise(-1).alias("gcomp"), (~inside & (F.col("from") > 1)).alias("open")))
    tokens = state.agg(F.sum(F.col("n") * (1.2 - similarity))).first()[0] or 0
    ready = reps.select("node", "tokens").join(state, "node")
    asked = written(_asked(ready, tokens, similarity, frequent, HOT).unionByName(state.filter("open").select("node", "sid")))
    more = _opened(docs, asked, state, similarity, width)

    # Rows that share a doc_id are one node: their classes are linked.
    every = written(_sets(every, width, similarity, None, False).join(reps.select("k1", "k2", "node", F.col("doc_id").alias("class_id")), ["k1", "k2"], "left").select("doc_id", "n", "node", "class_id"))
    twice = every.filter("doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    same = every.join(twice, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")
    roots = components(edges.unionByName(more).unionByName(same))
    named = reps.select("node", "doc_id").join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", F.coalesce("root", "node").alias("root"), "doc_id")
    least = named.groupBy("root").agg(F.min("doc_id").alias("component"))
    named = named.join(least, "root").select(F.col("node").alias("of"), "component")
    # A doc_id may belong to a component through another of its rows.
    ids = every.join(named, F.col("node") == F.col("of"), "left")
    found = twice.join(named, F.col("a") == F.col("of")).select(F.col("doc_id").alias("id"), F.col("component").alias("other"))
    ids = ids.join(found, F.col("doc_id") == F.col("id"), "left")
    known = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "other", "doc_id"))
    return ids.select("doc_id", F.col("n").alias("n_shingles"), known.alias("component_id"), F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("class_id", "doc_id")).alias("class_id"))


def ngram_sql() -> str:
    """DuckDB SQL for ngram_join() with five words and 0.8 over the table documents."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS root FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.root = e.a),
roots AS (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS class_id, list_sort(s) AS s FROM sets WHERE len(s) > 0 GROUP BY list_sort(s))
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles, least(sets.doc_id, coalesce(root, sets.doc_id)) AS component_id, coalesce(class_id, sets.doc_id) AS class_id
FROM sets LEFT JOIN roots ON roots.doc_id = sets.doc_id LEFT JOIN classes ON classes.s = list_sort(sets.s)"""
