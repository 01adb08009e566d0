"""Mixing sources to target weights by weighted fair queueing.

Documents of a source queue up in a shuffled order (a seeded hash of doc_id and text). A document's virtual finish time is the
number of words of its source up to its end, over the source's target. All sources' documents are then
sorted by that time, and the mix ends where the running total of words would exceed the budget; the next document of a source is still taken if that brings the source nearer to its target. A source may be passed through `repeat` times;
each pass follows the one before.

Running totals are taken in two levels, of buckets and within a bucket, so that no source and no global order meets in
one task. Buckets come from the hash and from the time, in a number that follows the rows: reruns agree.

Edge cases: a null text has size 0; documents of size 0 are never taken and never count; a null source is a source of its
own, last in order; rows that share a doc_id are ordered by a hash of their text and each counts as a document, and rows
equal in all of that are interchangeable; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import WORD, materialize, text_or_empty

WEIGHTS = (3, 1, 2)
SHARE, REPEAT, SEED = 1.5, 2, 42
#: Rows that a bucket holds on average.
BUCKET_ROWS = 10_000
#: A table with one row for each source is broadcast up to so many rows (under 2 MB), else joined by shuffle.
BROADCAST_SOURCES = 20_000


def sized(docs: DataFrame, seed: int = SEED, text: str = "text") -> DataFrame:
    """(doc_id, source, size, at, tie): the words of a document and its place in the shuffled order."""
    whole = text_or_empty(text)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(whole, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(whole, F.col("source").cast("string")).alias("tie"))
    return rows.withColumn("at", F.xxhash64(F.lit(seed), "doc_id", "tie"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT) -> DataFrame:
    """(source, source_size, weight, target), one row for each source.

    A target stops at repeat times the source's size; what is over is shared anew by weight. The end of that sharing is
    known at once: with sources sorted by cap / weight, the first ones stop at their caps and the rest share what is left.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row for each source
    ranked = sums.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_cap = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    caps = ranked.withColumn("cap", F.lit(float(repeat)) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    left = caps.withColumn("all_size", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every)).withColumn("cap_before", F.coalesce(F.sum("cap").over(by_cap), F.lit(0.0))).withColumn("weight_before", F.coalesce(F.sum("weight").over(by_cap), F.lit(0.0)))
    left = left.withColumn("level", (F.lit(share) * F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    stopped = F.col("ratio") <= F.col("level")
    final = F.max(F.when(~stopped, F.col("level"))).over(every)  # of the first source below its cap; later ones are lower
    return left.withColumn("target", F.when(stopped, F.col("cap")).otherwise(F.least(F.col("weight") * final, F.col("cap")))).select("source", "source_size", "rank", "weight", "target")


def with_targets(rows: DataFrame, goals: DataFrame) -> DataFrame:
    few = goals.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    g = F.broadcast(goals) if few else goals
    return rows.join(g.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")), "left").drop("_source")


def bucket(at: Column, n: int) -> Column:
    """Bucket 0..n-1 of a hash, in its order."""
    return F.least(F.floor((at.cast("double") / F.lit(2.0**64) + 0.5) * n), F.lit(n - 1)).cast("int")


def queued(rows: DataFrame, repeat: int = REPEAT) -> DataFrame:
    """rows (with targets) of each pass, with their virtual finish time."""
    n = max(1, -(-rows.count() // BUCKET_ROWS))
    cut = rows.where((F.col("size") > 0) & (F.col("target") > 0)).withColumn("_b", bucket(F.col("at"), n))
    sums = cut.groupBy("rank", "_b").agg(F.sum("size").alias("_sum"))
    before = sums.select("rank", "_b", (F.sum("_sum").over(Window.partitionBy("rank").orderBy("_b")) - F.col("_sum")).alias("_before"))
    own = F.sum("size").over(Window.partitionBy("rank", "_b").orderBy("at", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0))
    ends = cut.withColumn("_own", own).join(before, ["rank", "_b"]).withColumn("_end", F.col("_before") + F.col("_own")).drop("_b", "_own", "_before")
    passes = ends.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    return passes.withColumn("finish", (F.col("pass") * F.col("source_size") + F.col("_end")) / F.col("target")).drop("_end")


def front(queue: DataFrame, budget: float) -> tuple[DataFrame, DataFrame]:
    """The front of the queue in order of finish time, as long as the running total of sizes stays within the budget, and what comes after it."""
    n = max(1, -(-queue.count() // BUCKET_ROWS))
    cut = queue.withColumn("_b", F.floor(F.col("finish") * n).cast("long"))
    sums = cut.groupBy("_b").agg(F.sum("size").alias("_sum"))
    totals = sums.select("_b", F.sum("_sum").over(Window.orderBy("_b")).alias("_end"), "_sum").withColumn("_before", F.col("_end") - F.col("_sum"))  # one row for each bucket
    edge = totals.where((F.col("_before") <= budget) & (F.col("_end") > budget)).select("_b", "_before").first()
    if edge is None:
        return queue, queue.limit(0)
    order = Window.partitionBy("_b").orderBy("finish", "rank", "pass", "at", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    last = cut.where(F.col("_b") == edge["_b"]).withColumn("_run", F.sum("size").over(order) + edge["_before"])
    split = lambda outer, inner: cut.where(outer).unionByName(last.where(inner).drop("_run")).drop("_b")
    return split(F.col("_b") < edge["_b"], F.col("_run") <= budget), split(F.col("_b") > edge["_b"], F.col("_run") > budget)


def taken(queue: DataFrame, budget: float) -> DataFrame:
    """The front of the queue, and of each source the next in it where that brings the source nearer to its target: a long document at the cut would else leave its source short by up to its size.

    The total is then the budget, give or take half a document for each source.
    """
    got, rest = front(queue, budget)
    place = ["finish", "pass", "at", "doc_id", "tie"]
    so_far = got.groupBy("rank").agg(F.sum("size").alias("_got"))
    ahead = rest.groupBy("rank").agg(F.min(F.struct(*place, "size", "target")).alias("_next"))  # one row for each source
    gap = F.col("_next.target") - F.coalesce("_got", F.lit(0))
    wanted = ahead.join(so_far, "rank", "left").where(F.abs(gap - F.col("_next.size")) < F.abs(gap)).select(F.col("rank").alias("_rank"), *[F.col(f"_next.{c}").alias(f"_{c}") for c in place])
    wanted = materialize(wanted, "next")
    wanted = F.broadcast(wanted) if wanted.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES else wanted
    on = F.col("rank") == F.col("_rank")
    for c in place:
        on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    one = rest.join(wanted, on).select(rest.columns).dropDuplicates(["rank"])  # of equal rows one
    return got.unionByName(one)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeat: int = REPEAT, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(sized rows with their source's target, the copies taken with their finish times)."""
    rows = materialize(sized(docs, seed), "sizes")
    goals = materialize(targets(rows, weights, share, repeat), "targets")
    rows = with_targets(rows, goals)
    budget = goals.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    queue = materialize(queued(rows, repeat), "queue")
    # half a word of room: sums of doubles may fall short of a whole budget
    return rows, taken(queue, budget + 0.5)


def shared_out(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """rows with _own, the number of copies taken of each; equal rows (same doc_id, text and source) share theirs evenly, the first ones getting one more."""
    key = lambda df: df.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    n = key(copies).groupBy("_d", "tie").agg(F.count(F.lit(1)).alias("_n"))
    same = Window.partitionBy("_d", "tie")
    out = key(rows).join(n, ["_d", "tie"], "left").withColumn("_k", F.row_number().over(same.orderBy("_d"))).withColumn("_of", F.count(F.lit(1)).over(same))
    return out.withColumn("_own", F.floor((F.coalesce("_n", F.lit(0)) + F.col("_of") - F.col("_k")) / F.col("_of")).cast("int"))


def per_document(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) of every row."""
    rows, copies = mix(docs, **how)
    return shared_out(rows, copies).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("_own")).cast("long").alias("taken"))


def apply(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix, all their columns, a row for every copy taken, range-sorted by virtual finish time."""
    key = lambda df, doc_id="doc_id": df.withColumn("_d", F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))))
    _, copies = mix(docs, **how)
    names = {c: f"c_{i}" for i, c in enumerate(docs.columns)}
    same = Window.partitionBy("_d", "tie")
    rows = key(docs.withColumnsRenamed(names), names["doc_id"]).withColumn("tie", F.xxhash64(text_or_empty(names["text"]), F.col(names["source"]).cast("string")))
    rows = rows.withColumn("_k", F.row_number().over(same.orderBy(F.xxhash64(*names.values()))) - 1)
    # copies of equal rows go round among them, in order of time
    place = ["finish", "rank", "pass", "at"]
    numbered = key(copies).withColumn("_of", F.count(F.when(F.col("pass") == 0, 1)).over(same)).withColumn("_k", (F.row_number().over(same.orderBy(*place)) - 1) % F.greatest("_of", F.lit(1)))
    got = rows.join(numbered.select("_d", "tie", "_k", *place), ["_d", "tie", "_k"])
    order = [*place, "_d", "tie", "_k"]
    return got.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(v).alias(c) for c, v in names.items()])
