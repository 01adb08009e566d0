"""Embedding near-duplicates with an inverted multi-index.

Vectors are scaled to length one and cut into halves; each half has a codebook of its own, and the product of both is a grid of cells. A vector
lies in the cell of its nearest codewords and visits cells in order of summed squared distance, by the multi-sequence
algorithm. Labels are compared each on its own, so each has the grid that its size asks for: labels are put into levels by their number of vectors, a level's codebooks are fitted on a bounded sample
of its labels, with codewords in proportion to the root of a label's size, and labels of OUTRIGHT vectors or fewer are one cell. How many cells are visited is calibrated against the whole table: a bounded set of a level's probes is
compared with every vector of the level, and the cells must hold `recall` of the neighbours found, both of all and on average of a probe. Where too few probes have
a neighbour at all, made-up ones at exactly the threshold stand in. In each visited cell of its label the cosines with the cell's vectors are taken in double precision, and every pair at the
threshold or above is a link. A pair counts if either of the two visits the other's cell, once, for both.

Equal vectors are one row with a count before anything is compared. A cell's rows are dealt to blocks of bounded size, so that a crowded cell is
shared by many tasks; a block gives counts of links and the links that its components need, never all pairs.

Edge cases: vectors that are null, zero, of another length than most, or hold null or non-finite components, and rows with a null label, link with nothing: n_links 0, a
component of their own, kept. Repeated vec_ids count as rows of their own but share a component id; rows with a null vec_id take part and are never the
smallest. An empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.components import components
from fieldloom.llm.shared import materialize, small

COSINE, RECALL, SEED = 0.93, 0.99, 42
#: Vectors that codebooks are fitted on, and probes that visits are calibrated with, on average; probes with neighbours that are enough, else so many are made up for each.
SAMPLE, PROBES, ENOUGH, MADE_UP = 20_000, 2_000, 50, 4
#: Vectors that a cell should hold; codewords of a half at most, and vectors of the sample for each; vectors of a block.
CELL, CODEWORDS, PER_CODEWORD, BLOCK = 24, 2048, 8, 256
#: Vectors of a label that are compared without an index.
OUTRIGHT = 256


def multi_sequence(da: np.ndarray, db: np.ndarray, n: int) -> list[int]:
    """The n pairs (i, j) with the smallest da[i] + db[j], in order, as i * len(db) + j."""
    oa, ob = np.argsort(da, kind="stable"), np.argsort(db, kind="stable")
    sa, sb = da[oa], db[ob]
    out, seen, queue = [], {(0, 0)}, [(sa[0] + sb[0], 0, 0)]
    while queue and len(out) < n:
        _, i, j = heapq.heappop(queue)
        out.append(int(oa[i]) * len(db) + int(ob[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(sa) and y < len(sb) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(queue, (sa[x] + sb[y], x, y))
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = distances(x, centres).argmin(1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks of both halves and the number of cells that a search visits."""

    first: np.ndarray
    second: np.ndarray
    visits: int

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = self.first.shape[1]
        return distances(x[:, :d], self.first), distances(x[:, d:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return a.argmin(1) * len(self.second) + b.argmin(1)

    def visited(self, x: np.ndarray) -> list[list[int]]:
        a, b = self.halves(x)
        return [multi_sequence(p, q, self.visits) for p, q in zip(a, b, strict=True)]


    def rank(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells each x would visit before the given one."""
        out, n = np.zeros(len(x), "i8"), len(self.second)
        for k, (a, b) in enumerate(zip(*self.halves(x), strict=True)):
            out[k] = np.searchsorted(np.sort(b), a[cells[k] // n] + b[cells[k] % n] - a, "left").sum()
        return out


def level(n: Column) -> Column:
    """0 for labels of OUTRIGHT vectors or fewer; for others the power of two next to the codewords that their size asks for."""
    return F.when(n <= OUTRIGHT, 0).otherwise(F.greatest(F.round(F.log2(n / F.lit(float(CELL))) / 2), F.lit(1.0))).cast("int")


def fit(x: np.ndarray, level: int) -> MultiIndex:
    """Codebooks for labels of a level, from a sample x of their unit vectors."""
    half = x.shape[1] // 2
    k = max(1, min(2**level, CODEWORDS, len(x) // PER_CODEWORD))
    return MultiIndex(k_means(x[:, :half], k), k_means(x[:, half:], k), k * k)


def made_up(x: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Each of x again and again, and vectors at cosine `least` to it in random directions."""
    rng = np.random.default_rng(SEED)
    x = np.repeat(x, MADE_UP, 0)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    return x, least * x + (1 - least * least) ** 0.5 * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)


def enough(ranks: list[tuple[int, float, float]], recall: float) -> int:
    """The number of cells that hold `recall` of both weights. ranks: (cells before, weight, other weight)."""
    if not ranks:
        return 0
    r, a, b = (np.array(x, float) for x in zip(*sorted(ranks), strict=True))
    ok = (np.cumsum(a) >= recall * a.sum() - 1e-9) & (np.cumsum(b) >= recall * b.sum() - 1e-9)
    return int(r[np.flatnonzero(ok)[0]]) + 1


def calibrated(index: MultiIndex, nodes: DataFrame, probes: pd.DataFrame, least: float, recall: float) -> MultiIndex:
    """index with visits that find `recall` of the probes' neighbours (node, label, v) in the whole table; probes are a bounded set."""
    x, own = unit(probes["v"]), probes["node"].to_numpy()
    codes = {label: k for k, label in enumerate(probes["label"].unique())}
    of = probes["label"].map(codes).to_numpy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            if len(d):
                y = unit(d["v"])
                near = (y @ x.T >= least) & (d["label"].map(codes).fillna(-1).to_numpy()[:, None] == of) & (d["node"].to_numpy()[:, None] != own)
                i, p = np.nonzero(near)
                pairs, n = np.unique(np.stack([p, index.cells(y[np.unique(i)])[np.unique(i, return_inverse=True)[1]]], 1), axis=0, return_counts=True) if len(i) else (np.zeros((0, 2), "i8"), np.zeros(0, "i8"))
                yield pd.DataFrame({"probe": pairs[:, 0], "before": index.rank(x[pairs[:, 0]], pairs[:, 1]), "n": n})

    found = nodes.select("node", "label", "v").mapInPandas(run, "probe long, before long, n long").groupBy("probe", "before").agg(F.sum("n").alias("n"))
    found = materialize(found, "ranks")  # a row for each cell with neighbours of a probe
    with_any = found.select("probe").distinct().count()
    share = F.col("n") / F.sum("n").over(Window.partitionBy("probe"))
    ranks = [tuple(r) for r in found.withColumn("s", share).groupBy("before").agg(F.sum("s"), F.sum("n")).collect()]
    visits = enough(ranks, recall)
    if with_any < ENOUGH:
        a, b = made_up(x, least)
        visits = max(visits, enough([(int(r), 1.0, 1.0) for r in index.rank(a, index.cells(b))], recall))
    return MultiIndex(index.first, index.second, min(len(index.first) * len(index.second), max(visits, 2)))


def valid(v: str, size: Column | int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(v) == size) & (F.size(v) > 1) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(rows: list) -> np.ndarray:
    x = np.array(list(rows), float)
    x = x / np.abs(x).max(1, keepdims=True)  # squares of very small or large numbers stay in range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that hold the components of a block: rows a, columns b, near where they are linked."""
    label = np.arange(len(a), dtype="i8")
    rows = near.any(1)
    while True:  # the smallest row number spreads over rows and columns
        of_column = np.where(near, label[:, None], len(a)).min(0)
        new = np.minimum(label, np.where(near, of_column[None, :], len(a)).min(1, initial=len(a)))
        if (new == label).all():
            break
        label = new
    out = [(int(a[label[i]]), int(a[i])) for i in np.flatnonzero(rows) if label[i] != i]
    return out + [(int(a[of_column[j]]), int(b[j])) for j in np.flatnonzero(near.any(0)) if of_column[j] < len(a)]


OUT = "node long, other long, n long"


def compare(least: float):
    """Compare a block of searching vectors with a block of a cell's vectors. Rows out: (node, null, links found) and (node, other, 0) for components."""

    def run(key: tuple, probes: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(members):
            return pd.DataFrame({"node": [], "other": [], "n": []}, dtype="Int64")
        x, y = unit(probes["v"]), unit(members["m_v"])
        p, m = probes["node"].to_numpy(), members["m_node"].to_numpy()
        near = (x @ y.T >= least) & (p[:, None] != m[None, :])
        # a pair in which the member visits the searcher's cell too is found from there as well: that search counts for the member
        if near.any():
            homes, inverse = np.unique(probes["home"].to_numpy(), return_inverse=True)
            visits = np.stack(members["m_visits"].to_list())
            one_way = near & ~np.stack([(visits == h).any(1) for h in homes])[inverse]
        else:
            one_way = near
        for_probe = near @ members["m_n"].to_numpy()
        for_member = probes["n"].to_numpy() @ one_way
        links = forest(near, p, m) if near.any() else []
        node = np.concatenate([p[for_probe > 0], m[for_member > 0], np.array([a for a, _ in links], "i8")])
        other = [None] * int((for_probe > 0).sum() + (for_member > 0).sum()) + [b for _, b in links]
        n = np.concatenate([for_probe[for_probe > 0], for_member[for_member > 0], np.zeros(len(links), "i8")])
        return pd.DataFrame({"node": pd.array(node, "Int64"), "other": pd.array(other, "Int64"), "n": pd.array(n, "Int64")})

    return run


def near_duplicates(vectors: DataFrame, least: float = COSINE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label"))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").where("n > 1").first()
    dim = sizes["n"] if sizes else 2
    ok = valid("v", dim) & F.col("label").isNotNull()
    # equal vectors of a label are one node, named by two hashes, so that rows find it without moving their vectors
    keyed = rows.where(ok).withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64(F.lit(SEED), F.reverse("v"), "label")})
    nodes = keyed.groupBy("k1", "k2").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    labels = materialize(nodes.groupBy("label").agg(F.count(F.lit(1)).alias("_c")).select("label", level(F.col("_c")).alias("level"), "_c"), "labels")
    totals = {r["level"]: r["c"] for r in labels.groupBy("level").agg(F.sum("_c").alias("c")).collect()}  # one row for each power of two
    if not totals:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    leveled = nodes.join(small(labels.select("label", "level")), "label")

    def drawn(of: DataFrame, total: int, seed: int, n: int) -> pd.DataFrame:
        """n nodes, give or take, by a hash; one at least."""
        pick = F.pmod(F.xxhash64(F.lit(seed), "k1", "k2"), F.lit(1_000_000))
        some = of.where(pick < int(min(1.0, n / total) * 1_000_000) + 1).select("node", "label", "v").toPandas()
        return some if len(some) else of.orderBy(pick, "k1", "k2").limit(1).select("node", "label", "v").toPandas()

    indexes: dict[int, MultiIndex] = {}
    for own, total in sorted(totals.items()):
        if own:
            of = leveled.where(F.col("level") == own)
            index = fit(unit(drawn(of, total, SEED, SAMPLE)["v"]), own)
            indexes[own] = calibrated(index, of, drawn(of, total, SEED + 1, PROBES), least, recall)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            for own, part in d.groupby("level"):
                if own in indexes:
                    x = unit(part["v"])
                    yield part.assign(home=indexes[own].cells(x), visits=indexes[own].visited(x)).drop(columns="level")
                else:
                    yield part.assign(home=0, visits=[[0]] * len(part)).drop(columns="level")

    to_place = leveled.select("node", "label", "n", "v", "level")
    placed = materialize(to_place.mapInPandas(place, f"{to_place.drop('level')._jdf.schema().toDDL()}, home long, visits array<long>"), "cells")
    deal = lambda c, salt, n: F.pmod(F.xxhash64(F.lit(salt), c), n)
    homes = placed.groupBy("label", "home").agg(F.count(F.lit(1)).alias("_m")).withColumnRenamed("home", "cell")
    coming = placed.select("label", F.explode("visits").alias("cell")).groupBy("label", "cell").agg(F.count(F.lit(1)).alias("_p"))
    # a cell of m vectors that p vectors visit is a grid of blocks; both sides go to every block of their row or column
    grid = materialize(homes.join(coming, ["label", "cell"]).select("label", "cell", F.ceil(F.col("_m") / BLOCK).alias("mb"), F.ceil(F.col("_p") / BLOCK).alias("pb")), "grid")
    members = placed.withColumnRenamed("home", "cell").join(grid, ["label", "cell"]).withColumn("mk", deal("node", 1, F.col("mb"))).withColumn("pk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pb") - 1)))
    probes = placed.withColumn("cell", F.explode("visits")).join(grid, ["label", "cell"]).withColumn("pk", deal("node", 2, F.col("pb"))).withColumn("mk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("mb") - 1)))
    by = ["label", "cell", "mk", "pk"]
    found = probes.select(*by, "node", "n", "v", "home").groupBy(*by).cogroup(members.select(*[F.col(c).alias(f"m_{c}") for c in (*by, "node", "n", "v", "visits")]).groupBy(*[f"m_{c}" for c in by])).applyInPandas(compare(least), OUT)
    found = materialize(found, "links")
    counts = found.where("other IS NULL").groupBy("node").agg(F.sum("n").alias("_links"))
    roots = components(found.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    rooted = nodes.select("node", "k1", "k2", "vec_id", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    ids = rooted.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    known = materialize(rooted.join(ids, "root").select("k1", "k2", (F.coalesce("_links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "known")
    linked = keyed.select("vec_id", "k1", "k2").join(known, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
