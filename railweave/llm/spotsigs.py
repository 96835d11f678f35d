"""SpotSigs fingerprints, with DataFrame functions only.

Words are runs of letters and digits in lower case.  Behind every common word (the
anchor, FIXED VALUES below) stands a chain: the first `CHAIN` content words (not
common themselves) among the next `SPAN` words.  Anchor and chain make a signature;
the fingerprint is the sorted set of the signatures' 32-bit hashes.  Common words
make up prose but not menus or lists, so signatures sit on running text.

likeness() is the Jaccard coefficient of two fingerprints.  near_classes() finds near duplicates:
fingerprints are partitioned by set length so that only neighbouring partitions can
hold partners, candidates share one of their rarest signatures, and pairs whose
lengths already rule out the threshold are pruned before sets are compared.

Defined results: null counts as empty; empty texts have an empty fingerprint and
likeness 1 to one another, 0 to others.  A text without signatures has one of each
word (or, without words, of itself), so equal texts have equal fingerprints.  Next
is the row with the next smaller doc_id, after the last the first; of rows that
share a doc_id the order is that of their texts' hashes.  A row without doc_id stands
alone: its next document is an empty one.  Other columns are not read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import components, fresh, written

CHAIN = 2
SPAN = 8
#: Rows of a run of doc_ids, about.
RUN = 1024
#: Most quantiles of doc_ids within which runs are laid.
PARTS = 256
#: Rounds in which near_classes() takes out what is like the first of its group.
LEADERS = 3
# FIXED VALUES: common words of English, German, French and Spanish.
COMMON = tuple(dict.fromkeys("""
the a an of to and in is was that it for on are by as with be this from or at have not which what
der die das und von zu den mit ist ein eine einer für auf nicht im in dem des als auch sich bei es
le la les de des un une et est en du que qui dans pour pas sur par au avec elle il ce
el la los las de que y en un una por con no es para del al se lo su
""".split()))


def signatures(text: Column, words: Column, content: Column) -> Column:
    """Sorted distinct signature hashes; words and content (null for common words) must be materialised columns."""

    def spot(w: Column, i: Column) -> Column:
        chain = F.array_join(F.slice(F.array_compact(F.slice(content, i + 2, SPAN)), 1, CHAIN), " ")
        return F.when(F.get(content, i).isNull(), F.struct(w.alias("w"), chain.alias("chain")))

    spots = F.transform(F.filter(F.transform(words, spot), lambda x: x["chain"] != ""), lambda x: F.hash(x["w"], x["chain"]))
    spots = F.array_sort(F.array_distinct(spots))
    alone = F.when(F.size(words) > 0, F.array_sort(F.array_distinct(F.transform(words, lambda w: F.hash(F.lit(""), w))))).otherwise(F.array(F.hash(F.lit(""), text)))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<int>")).when(F.size(spots) > 0, spots).otherwise(alone)


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """df with the signature set of a text column."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    split, content = fresh("spot_words", df.columns), fresh("spot_content", df.columns)
    df = df.withColumn(split, words)
    df = df.withColumn(content, F.transform(split, lambda w: F.when(~w.isin(list(COMMON)), w)))
    return df.withColumn(name, signatures(F.col(text), F.col(split), F.col(content))).drop(split, content)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two sorted distinct arrays; of two empty ones, 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _runs(df: DataFrame) -> tuple[Column, Column]:
    """Part and run of a doc_id, rising with it: quantiles, and about `RUN` rows each within.

    Parts are at most `PARTS`, so outlying ids thin out the runs of their own part only.
    """
    n = df.count()
    parts = max(1, min(PARTS, n // RUN))
    marks = df.agg(F.percentile_approx("doc_id", [k / parts for k in range(parts + 1)], 20 * parts)).first()[0] if n else None
    marks = sorted(set(marks or [0]))
    lows = marks[:-1] or marks
    runs = max(1, n // (RUN * parts))
    widths = [max(1.0, (float(hi) - float(lo)) / runs) for lo, hi in zip(lows, marks[1:] or marks, strict=True)]
    array = lambda values, kind: F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")
    part = F.greatest(F.lit(1), F.size(F.filter(array(lows, "bigint"), lambda low: low <= F.col("doc_id"))))
    # Doubles: casts and quotients keep the order, and no difference of two ids overflows.
    run = F.floor((F.col("doc_id").cast("double") - F.element_at(array(lows, "bigint"), part).cast("double")) / F.element_at(array(widths, "double"), part))
    return part.cast("int"), run


def in_runs(df: DataFrame) -> DataFrame:
    """df(doc_id, ...) with part, run and copy: each run also holds a copy of the first row of the run that follows it."""
    part, run = _runs(df)
    rows = df.withColumn("part", part).withColumn("run", run)
    heads = written(rows.groupBy("part", "run").agg(F.max("doc_id").alias("doc_id")))
    # A part's first run takes over from the last run of the part above, the topmost from the lowest of all.
    ends = heads.groupBy("part").agg(F.min("run").alias("low")).orderBy("part").collect()
    above = [(x.part, ends[(i + 1) % len(ends)].part, ends[(i + 1) % len(ends)].low) for i, x in enumerate(ends)]
    above = F.broadcast(df.sparkSession.createDataFrame(above, "part int, next_part int, next_run long"))  # at most PARTS rows
    after = F.lead("run").over(Window.partitionBy("part").orderBy("run"))
    heads = heads.withColumn("after", after).join(above, "part")
    # Written, so that its size is known before texts would be shuffled for the join.
    heads = written(heads.select("doc_id", F.when(F.col("after").isNull(), F.col("next_part")).otherwise(F.col("part")).alias("part"), F.coalesce("after", "next_run").alias("run")))
    copies = df.join(heads, "doc_id").select(*df.columns, "part", "run", F.lit(True).alias("copy"))
    return rows.withColumn("copy", F.lit(False)).unionByName(copies)


def with_next(every: DataFrame, columns: list[str]) -> DataFrame:
    """in_runs() rows with next_<column> of the row with the next smaller doc_id."""
    near = Window.partitionBy("part", "run").orderBy("copy", F.desc("doc_id"), F.xxhash64("text"))
    return every.select("*", *(F.lead(c).over(near).alias(f"next_{c}") for c in columns)).filter(~F.col("copy")).drop("part", "run", "copy")


def _text_of(fingerprint: Column) -> Column:
    return F.array_join(fingerprint.cast("array<string>"), " ")


def fingerprint_query(docs: DataFrame) -> DataFrame:
    """Digest columns of every document, its edited text and its next document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    # Signatures come after the copies, so that none is made twice.
    rows = with_next(with_signatures(in_runs(docs.filter("doc_id is not null")), "text", "spots"), ["text", "spots"])
    lone = with_signatures(docs.filter("doc_id is null"), "text", "spots").withColumns({"next_text": F.lit(""), "next_spots": F.array().cast("array<int>")})
    rows = rows.unionByName(lone)
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "spots", "next_spots", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut)).alias("edited"))
    rows = with_signatures(rows, "edited", "edited_spots")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), _text_of(F.col("spots")).alias("fingerprint"), _text_of(F.col("edited_spots")).alias("edited_fingerprint"), likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"), likeness(F.col("spots"), F.col("next_spots")).alias("near_next"))


def near_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, class_id): the smallest doc_id reachable through near-duplicate fingerprints.

    Equal fingerprints are one class before anything is joined.  Candidates share
    one of the n - ceil(t n) + 1 rarest signatures of each and lie in the same or
    the next partition of set lengths: the sets of a signature, a partition and the
    one before are a group.  In each of `LEADERS` rounds the sets of a group that
    have no leader yet are compared with the first of them, and those like it have
    it as their leader.  Sets with one leader are one class and not compared again;
    all other pairs of a group are.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    sets = with_signatures(docs, "text", "spots").select("doc_id", "spots", F.sha2(_text_of(F.col("spots")), 256).alias("key"))
    reps = written(sets.groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("spots").alias("spots")).filter(F.size("spots") > 0))
    size = F.size("spots")
    often = reps.select(F.explode("spots").alias("spot")).groupBy("spot").agg(F.count("*").alias("often"))
    ranked = reps.select("rep", size.alias("n"), F.explode("spots").alias("spot")).join(often, "spot")
    place = F.row_number().over(Window.partitionBy("rep").orderBy("often", "spot"))
    kept = ranked.withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / similarity)))
    kept = kept.filter("often > 1").select("rep", "n", "spot", part.alias("part"))
    groups = written(kept.select("spot", F.explode(F.array(F.struct(F.col("part").alias("group"), F.lit(True).alias("own")), F.struct((F.col("part") + 1).alias("group"), F.lit(False).alias("own")))).alias("g"), "rep", "n").select("spot", "g.group", "rep", "n", "g.own", F.lit(None).cast("long").alias("leader")))
    links = None
    for _ in range(LEADERS):
        first = groups.filter("leader is null").groupBy("spot", "group").agg(F.min("rep").alias("first"))
        asked = groups.filter("leader is null").join(first, ["spot", "group"]).select("rep", "first").distinct()
        asked = asked.join(reps.select("rep", F.col("spots").alias("x")), "rep").join(reps.select(F.col("rep").alias("first"), F.col("spots").alias("y")), "first")
        like = written(asked.filter(likeness(F.col("x"), F.col("y")) >= similarity).select("rep", "first"))
        new = like.filter("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
        links = links.union(new) if links else new
        led = first.join(like, "first").select("spot", "group", "rep", "first")
        groups = written(groups.join(led, ["spot", "group", "rep"], "left").select("spot", "group", "rep", "n", "own", F.coalesce("leader", "first").alias("leader")))
    left = groups.select("spot", "group", F.col("rep").alias("a"), F.col("n").alias("an"), F.col("leader").alias("al"))
    right = groups.filter("own").select("spot", "group", F.col("rep").alias("b"), F.col("n").alias("bn"), F.col("leader").alias("bl"))
    pairs = left.join(right, ["spot", "group"]).filter("a <> b and (an < bn or an = bn and a < b) and (al is null or bl is null or al <> bl)").filter(F.col("an") >= F.col("bn") * similarity - 1e-9).select("a", "b").distinct()
    pairs = pairs.join(reps.select(F.col("rep").alias("a"), F.col("spots").alias("x")), "a").join(reps.select(F.col("rep").alias("b"), F.col("spots").alias("y")), "b")
    roots = components(pairs.filter(likeness(F.col("x"), F.col("y")) >= similarity).select("a", "b").union(links).distinct())
    named = reps.select("key", "rep").join(roots, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("root", "rep").alias("class_id"))
    return sets.select("doc_id", "key").join(named, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))
