"""SimHash near copies at a word similarity: five-word shingles at Jaccard 0.8 or more, found by balls of short fingerprints.

Sets at Jaccard 0.8 differ in about 15 % of SimHash bits: ten of 64, and balls of half that radius are far too large. So the fingerprint is
searched in pieces: each of TABLES bytes of it emits itself and its eight one-bit variants, which finds all bytes within two bits of each
other (chance 0.89 at 0.8). A byte alone is shared by far too many documents, so a variant counts together with its anchor, the smallest
of the table's hashes over the shingles, which sets share with a chance that is their similarity. With six tables a pair at 0.8 meets with chance 0.9994
by formula. Who meets is deduplicated, compared by long fingerprints (PARTS of 64 bits, at most FAR bits apart: over four deviations at 0.8),
and verified by the exact similarity of both sets.

Groups are components of verified pairs. Texts with equal sets are one node. Nodes of one variant are put in order and paired with the WIDTH before
them; where more nodes share an anchor and are then still in several components, all remaining pairs of like size between components are compared, in
blocks dealt to many tasks, which give the pairs that join components, never all. So no pair that meets is left out, while a large group of copies in one component costs a few comparisons a member.

Edge cases: as in simhash: a null text is empty; a text shorter than a shingle has one shingle of all its words, one without words has none
and is equal to others without; a null doc_id counts as smallest; one row stays of repeated rows, the first by a hash of all its columns; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.llm.shared import drop, materialize, scratch, small, text_or_empty
from fieldloom.llm.simhash import majority

SHINGLE, JACCARD, SEED = 5, 0.8, 42
TABLES, PARTS, FAR = 6, 4, 72
WIDTH, BLOCK = 2, 1024
#: Rows of an Arrow batch out, and shingles worked on at once.
SLICE, CHUNK = 500, 1 << 16
LEAST = -(2**63)
ODD = np.random.default_rng(SEED).integers(0, 2**63, SHINGLE + PARTS + TABLES, dtype="u8") * np.uint64(2) + np.uint64(1)
SKETCH = [f"a{k}" for k in range(TABLES)] + [f"f{k}" for k in range(PARTS)]


def spread_bits(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit ids of the runs of SHINGLE words (A-Z lower-cased)."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: ASCII only
    if not words:
        return np.zeros(0, "u8")
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        return np.array([digest(b" ".join(words), SEED)], "u8")
    h, n = np.array([digest(w, SEED) for w in words], "u8"), len(words) - SHINGLE + 1
    runs = np.zeros(n, "u8")
    for k in range(SHINGLE):
        runs += spread_bits(h[k : k + n] * ODD[k])
    return np.unique(spread_bits(runs))


def sketch(own: np.ndarray) -> list[int]:
    """The anchors of all tables, then the parts of the fingerprint, as signed numbers."""
    least = np.full(TABLES, 2**64 - 1, "u8")
    for k in range(TABLES):
        for at in range(0, len(own), CHUNK):
            least[k] = min(least[k], spread_bits(own[at : at + CHUNK] * ODD[SHINGLE + k]).min())
    parts = [majority(spread_bits(own * f)) for f in ODD[SHINGLE + TABLES :]]
    return [*least.view("i8").tolist(), *np.array(parts, "u8").view("i8").tolist()]


def node_of(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63


def sketches(texts: DataFrame) -> DataFrame:
    """(d, t, node, some, size, anchors, fingerprint) of every row of texts (d, t, text): node names its set of shingles, size is how many it has, some whether it has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows = [(node_of(s), len(s), sketch(s)) for s in (shingles(x.as_py()) for x in batch.column(2))]
                numbers = np.array([r[2] for r in rows], "i8").reshape(-1, len(SKETCH))
                columns = [batch.column(0), batch.column(1), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] > 0 for r in rows]), pa.array([r[1] for r in rows], pa.int32()), *(pa.array(numbers[:, k].copy()) for k in range(len(SKETCH)))]
                yield pa.RecordBatch.from_arrays(columns, names=["d", "t", "node", "some", "size", *SKETCH])

    return texts.mapInArrow(run, "d long, t long, node long, some boolean, size int, " + ", ".join(f"{c} long" for c in SKETCH))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(node, own): the sets of texts (d, t, text), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                sets = [shingles(x.as_py()) for x in whole.column(2).slice(at, SLICE)]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "own"])

    return texts.mapInArrow(run, "node long, own binary").dropDuplicates(["node"])


def variants(nodes: DataFrame, *more: str) -> DataFrame:
    """(key, node): the byte of each table and its eight neighbours, each with the table's anchor; and more columns of nodes."""
    shift = lambda what, x, n: F.call_function(what, x, n)
    tables = nodes.select("node", *more, "f0", F.posexplode(F.array(*SKETCH[:TABLES])).alias("_t", "_a"))
    byte = shift("shiftrightunsigned", F.col("f0"), (F.col("_t") * 8).cast("int")).bitwiseAND(F.lit(255).cast("long"))
    balls = tables.select("node", *more, "_t", "_a", byte.alias("_f"), F.explode(F.sequence(F.lit(-1), F.lit(7))).alias("_i"))
    bit = F.when(F.col("_i") < 0, F.lit(0).cast("long")).otherwise(shift("shiftleft", F.lit(1).cast("long"), F.greatest("_i", F.lit(0))))
    return balls.select(F.xxhash64("_t", "_a", F.col("_f").bitwiseXOR(bit)).alias("key"), "node", *more)


def apart(a: str, b: str) -> Column:
    """Bits that differ between the fingerprints of two sides."""
    return sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(1, PARTS)), F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))))


def prints(nodes: DataFrame, node: str, prefix: str) -> DataFrame:
    return nodes.select(F.col("node").alias(node), *[F.col(f"f{k}").alias(f"{prefix}{k}") for k in range(PARTS)])


def neighbours(balls: DataFrame) -> DataFrame:
    """(a, b): distinct pairs of nodes that stand at WIDTH places or fewer from one another for some key, in order of node."""
    ring = Window.partitionBy("key").orderBy("node")
    before = F.array(*[F.lag("node", n).over(ring) for n in range(1, WIDTH + 1)])
    pairs = balls.withColumn("_b", before).where("_b[0] IS NOT NULL").select(F.explode("_b").alias("a"), F.col("node").alias("b"))
    return pairs.where("a IS NOT NULL").distinct()


def briefs(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, brief): fingerprint and shingles of 32 bits each, sorted; enough to rule out nearly all pairs below JACCARD and none above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = np.stack([batch.column(2 + k).to_numpy() for k in range(PARTS)], 1)
            short = [np.sort((np.frombuffer(x.as_py(), "u8") >> np.uint64(32)).astype("u4")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.tobytes() + x.tobytes() for f, x in zip(parts, short, strict=True)], pa.binary())], names=["node", "brief"])

    return sets.join(nodes.select("node", *SKETCH[TABLES:]), "node").select("node", "own", *SKETCH[TABLES:]).mapInArrow(run, "node long, brief binary")


def joined(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a block that join components (roots): rows of side 0 against rows of side 1, only as many as the components need."""
    own, others = (group[group["side"] == k] for k in (0, 1))
    root: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = x = root.get(y, y)
        return x

    prints_ = [np.array([np.frombuffer(x, "u8", PARTS) for x in side["brief"]], "u8").reshape(-1, PARTS) for side in (own, others)]
    sets = [np.frombuffer(x, "u4", -1, 8 * PARTS) for x in others["brief"]]
    sizes, nodes, roots = np.array([len(x) for x in sets]), others["node"].to_numpy(), others["root"].to_numpy()
    for node, r, f, brief in zip(own["node"], own["root"], prints_[0], own["brief"], strict=True):
        mine = np.frombuffer(brief, "u4", -1, 8 * PARTS)
        close = np.bitwise_count(prints_[1] ^ f).sum(1) <= FAR
        close &= (nodes != node) & (sizes >= JACCARD * len(mine)) & (len(mine) >= JACCARD * sizes)
        at = [k for k in np.flatnonzero(close).tolist() if find(int(roots[k])) != find(int(r))]
        if not at:
            continue
        flat = np.concatenate([sets[k] for k in at])
        both = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat, np.cumsum([0, *sizes[at][:-1]]), dtype="i8")
        for k in np.array(at)[both >= JACCARD * (len(mine) + sizes[at] - both)].tolist():
            x, y = find(int(r)), find(int(roots[k]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((int(node), int(nodes[k])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def remaining(nodes: DataFrame, roots: DataFrame, short: DataFrame) -> DataFrame:
    """(a, b): pairs that join components of those who share a table's anchor, where more than WIDTH + 1 nodes do, by comparing all that are in several components.

    Balls aren't needed here: a node has one row for each table, in place of one for each variant, and bytes that are further apart only add comparisons. With each anchor the nodes outside of
    its largest component are compared with all of like size. They are dealt by steps of size, which sets at JACCARD have in common or next to each other, and then to blocks of BLOCK nodes.
    """
    tables = nodes.where("some").join(roots, "node", "left").select("node", "size", F.coalesce("root", "node").alias("root"), F.posexplode(F.array(*SKETCH[:TABLES])).alias("_t", "_a"))
    held = tables.select(F.xxhash64("_t", "_a").alias("key"), "node", "size", "root")
    large = held.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("_lo"), F.max("root").alias("_hi")).where((F.col("n") > WIDTH + 1) & (F.col("_lo") < F.col("_hi")))
    members = materialize(held.join(materialize(large.select("key"), "large"), "key"), "members")
    by_root = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    main = materialize(by_root.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("_main")), "main")
    level = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(JACCARD))).cast("int")
    outside = materialize(members.join(main, "key").where("root <> _main").select("key", level.alias("level"), "node", "size", "root"), "outside")
    spans = materialize(outside.groupBy("key", "level").agg(F.count(F.lit(1)).alias("_o"), F.min("size").alias("_least"), F.max("size").alias("_most")), "sizes")
    like = members.alias("m").join(spans.alias("s"), (F.col("m.key") == F.col("s.key")) & (F.col("m.size") >= JACCARD * F.col("s._least")) & (JACCARD * F.col("m.size") <= F.col("s._most")))
    like = materialize(like.select("m.key", "s.level", "m.node", "m.root"), "like")
    blocks = spans.join(like.groupBy("key", "level").agg(F.count(F.lit(1)).alias("_n")), ["key", "level"]).select("key", "level", F.ceil(F.col("_o") / BLOCK).alias("_i"), F.ceil(F.col("_n") / BLOCK).alias("_j"))
    blocks = materialize(blocks, "blocks")
    deal = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = outside.join(blocks, ["key", "level"]).select("key", "level", deal(1, "_i").alias("i"), each("_j").alias("j"), "node", "root", F.lit(0).alias("side"))
    columns = like.join(blocks, ["key", "level"]).select("key", "level", each("_i").alias("i"), deal(2, "_j").alias("j"), "node", "root", F.lit(1).alias("side"))
    return rows.unionByName(columns).join(short, "node").groupBy("key", "level", "i", "j").applyInPandas(joined, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets (node, own) are at JACCARD or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(s.as_py(), "u8") for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= JACCARD * max(len(x), len(y)) else 0
                near.append(both >= JACCARD * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    a, b = (sets.select(F.col("node").alias(k), F.col("own").alias(f"_{k}")) for k in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "_a", "_b").mapInArrow(run, "a long, b long")


def links(texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links of nodes for the components of all verified pairs: each node with the smallest that such pairs reach, and the pairs found after."""
    balls = variants(nodes.where("some"))
    found = materialize(neighbours(balls), "met")
    meeting = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    wanted = materialize(meeting.join(nodes.select("node", "_k.d", "_k.t"), "node").select("d", "t"), "wanted")
    # the sets of nodes that meet any other, made anew from one text of each
    sets = materialize(shingle_sets(texts.join(small(wanted), ["d", "t"], "left_semi")), "sets")
    close = found.join(prints(nodes, "a", "x"), "a").join(prints(nodes, "b", "y"), "b").where(apart("x", "y") <= FAR).select("a", "b")
    close = materialize(verified(close, sets), "near")
    roots = materialize(components(close), "roots")
    rest = materialize(remaining(nodes, roots, materialize(briefs(sets, nodes), "briefs")), "rest")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(verified(rest, sets))


def one_of_each(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest doc_id (null, if it is there, counts as smallest)."""
    columns = [f"c_{k}" for k in range(len(docs.columns))]
    inner = docs.select(*[F.col(c).alias(k) for c, k in zip(docs.columns, columns, strict=True)], F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("d"), F.xxhash64(text_or_empty(text)).alias("t"))
    texts = inner.select("d", "t", F.col(columns[docs.columns.index(text)]).alias("text"))
    with scratch() as tables:
        rows = materialize(sketches(texts), "sketches")
        firsts = [F.first(c).alias(c) for c in ("some", "size", *SKETCH)]  # rows of a node agree in them
        nodes = materialize(rows.groupBy("node").agg(F.min(F.struct("d", "t")).alias("_k"), *firsts), "nodes")
        roots = components(links(texts, nodes))
        first = materialize(nodes.select("node", "_k").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("_k").alias("_k")).select("_k.d", "_k.t"), "kept")
        # texts move only where rows are equal in (d, t), unless very many rows go
        keys = rows.groupBy("d", "t").agg(F.count(F.lit(1)).alias("_n"))
        gone = materialize(keys.join(first, ["d", "t"], "left_anti").select("d", "t"), "gone")
        equal = materialize(keys.where("_n > 1").join(first, ["d", "t"], "left_semi").select("d", "t"), "equal")
        drop(tables, gone, equal)
    order = Window.partitionBy("d", "t").orderBy(F.xxhash64(*columns), *[F.col(c).cast("string") for c in columns])
    one = inner.join(small(equal), ["d", "t"], "left_semi").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    out = inner.join(small(gone.unionByName(equal)), ["d", "t"], "left_anti").unionByName(one.select(*inner.columns))
    return out.select(*[F.col(k).alias(c) for c, k in zip(docs.columns, columns, strict=True)])
