"""Line dedup: a suffix array over the sequences of line ids, by distributed prefix doubling.

A line's id is a hash of its text without outer white space; lines without a word have no place in a sequence. Lines that occur once in the corpus end
every repeated run, so suffixes start at the other lines and end before the next such line. Ranks double their reach each round:
a suffix's next rank orders it by its own rank and that of the suffix 2^k lines on. Ranks come from a range sort of the distinct pairs,
aggregated first, so a frequent line is one pair, not one group.

A run counts if it has MIN_WORDS words. Every line of a longer run lies in a run of MIN_WORDS lines or fewer that counts too (each line
has a word), so ranks and longest common prefixes need to reach MIN_WORDS lines and no further; the lines removed are those of maximal runs.

In suffix order, neighbours' longest common prefixes open and close intervals; a stack gives each suffix the nearest neighbours on both sides
that stand earlier in the corpus, and with them the longest run that has an earlier copy. Sorted parts are worked on
apart; what crosses their borders is, per part, the earliest place for each prefix length at its first and last suffix.

The corpus is in order of doc_id (null first), then a hash of the text, then line. Edge cases: a null text is empty; rows equal in doc_id and text
are copies of the first of them (by a hash of all columns), and lose everything if they have MIN_WORDS words; an empty table gives an empty table; texts of any length are
treated whole; other columns pass through `dedup` unchanged, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.runs import slices
from fieldloom.llm.shared import drop, materialize, release, scratch, text_or_empty

#: Words that a run needs to count. Lines of a few words (greetings, headings, list items) recur in clean texts; the README has figures for other values.
MIN_WORDS = 5
#: Suffixes that one part holds, about: the number of parts follows the rows.
PART_ROWS = 50_000
SPACES = " \t\n\x0b\x0c\r"
HAS_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LEAST = -(2**63)


def doc_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LEAST))


def text_key(text: str = "text") -> Column:
    return F.xxhash64(text_or_empty(text))


def line_parts(text: str | None) -> list[tuple[int, int, int]]:
    """(line number, id, words) of every line with a word."""
    out = []
    for k, line in enumerate((text or "").encode("utf-8", "replace").split(b"\n")):
        words = HAS_WORD.findall(line)
        if words:
            out.append((k, xxhash.xxh3_64_intdigest(line.strip(SPACES.encode())) - 2**63, len(words)))
    return out


def line_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """(d, t, j, line, h, w): every line with a word, j its place among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            d, t = (batch.column(k).to_numpy() for k in (0, 1))
            parts = [np.array(line_parts(x.as_py()), "i8").reshape(-1, 3) for x in batch.column(2)]
            n = [len(p) for p in parts]
            flat = np.concatenate(parts) if parts else np.zeros((0, 3), "i8")
            j = np.concatenate([np.arange(x) for x in n]) if n else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(d, n)), pa.array(np.repeat(t, n)), pa.array(j.astype("i4")), pa.array(flat[:, 0].astype("i4")), pa.array(flat[:, 1]), pa.array(flat[:, 2].astype("i4"))], names=["d", "t", "j", "line", "h", "w"])

    return docs.select(doc_key().alias("d"), text_key(text).alias("t"), F.col(text)).mapInArrow(run, "d long, t long, j int, line int, h long, w int")


def ranked(pairs: DataFrame) -> DataFrame:
    """Distinct (r1, r2) with n and an order-preserving rank: the id of a row in range-sorted parts."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = pairs.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"))
    return materialize(counts.repartitionByRange(n, "r1", "r2").sortWithinPartitions("r1", "r2").select("r1", "r2", "n", F.monotonically_increasing_id().alias("r")), "ranks")


def suffix_ranks(lines: DataFrame, reach: int) -> DataFrame:
    """lines (d, t, j, h, ...) with r: the rank of each suffix by its first `reach` lines, by prefix doubling."""
    state, span, last = materialize(lines.withColumn("r", F.col("h")), "suffixes"), 1, None
    others = lines.columns
    in_doc = Window.partitionBy("d", "t").orderBy("j")
    while span < reach:
        # span rows on in the document and span places on: no line between is missing
        there = F.when(F.lead("j", span).over(in_doc) == F.col("j") + span, F.lead("r", span).over(in_doc))
        pairs = state.select(*others, F.col("r").alias("r1"), there.alias("_r2")).withColumn("r2", F.coalesce("_r2", F.lit(LEAST))).drop("_r2")
        ranks = ranked(pairs.select("r1", "r2"))
        if ranks.where("r2 > {}".format(LEAST)).limit(1).count() == 0:
            break  # no suffix reaches further: the order is final
        after = materialize(pairs.join(ranks.select("r1", "r2", "r"), ["r1", "r2"]).select(*others, "r"), "suffixes")
        release(state)
        release(last)
        state, last, span = after, ranks, 2 * span
    return state


def suffixes(docs: DataFrame, min_words: int, text: str = "text") -> DataFrame:
    """(d, t, j, r, hs, ws): every suffix of lines that occur more than once, with its rank and the ids and words of its first min_words lines at most."""
    lines = materialize(line_table(docs, text), "lines")
    # written before it is joined: a very common line then makes a skewed part of two plain shuffles, which Spark can split
    often = materialize(lines.groupBy("h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("h"), "often")
    again = lines.join(often, "h").dropDuplicates(["d", "t", "j"])
    ranks = suffix_ranks(again.select("d", "t", "j", "h", "w"), min_words)
    frame = Window.partitionBy("d", "t").orderBy("j").rowsBetween(0, min_words - 1)
    heads = ranks.withColumn("_c", F.collect_list(F.struct("j", "h", "w")).over(frame)).withColumn("_c", F.filter("_c", lambda x, k: x["j"] == F.col("j") + k))
    return heads.select("d", "t", "j", "r", F.col("_c.h").alias("hs"), F.col("_c.w").alias("ws"))


def common(a: list[int], b: list[int]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """The parts of a partition, each with its rows ((d, t, j), hs, ws) in suffix order."""
    now, rows = None, []
    for batch in batches:
        for p, d, t, j, hs, ws in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if p != now and rows:
                yield now, rows
                rows = []
            now = p
            rows.append(((d, t, j), hs, ws))
    if rows:
        yield now, rows


#: JSON keeps the nested lists of a border short to declare: first, last, shared, low, high.
BORDERS = "part int, border string"


def borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part: its first and last suffix, their common prefix, and by prefix length the earliest place that shares so much with the first, and with the last."""
    for part, rows in by_part(batches):
        place, first, _ = rows[0]
        low, high, shared, before = [place] * len(first), [place] * len(first), len(first), first
        for place, hs, _ in rows[1:]:
            k = common(before, hs)
            shared = min(shared, k)
            low[:shared] = [min(x, place) for x in low[:shared]]
            high = [min(x, place) for x in high[:k]] + [place] * (len(hs) - k)
            before = hs
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([json.dumps([first, before, shared, low, high])])], names=["part", "border"])


def carried(rows: list) -> dict[int, tuple[list, list, list, list]]:
    """For each part: its first and last suffix, and by prefix length the earliest place in all parts before it that shares so much with the first, and in those after it with the last."""
    parts = {r["part"]: json.loads(r["border"]) for r in sorted(rows, key=lambda r: r["part"])}

    def sweep(order: list[int], near: int, far: int, edge: int) -> dict[int, list]:
        out, stair, before = {}, [], None
        for part in order:
            if before is not None:
                b = parts[before]
                reach = common(b[far], parts[part][near])
                stair = [min(tuple(b[edge][k]), stair[k]) if k < min(b[2], len(stair)) else tuple(b[edge][k]) for k in range(reach)]
            out[part], before = stair, part
        return out

    left, right = sweep(list(parts), 0, 1, 4), sweep(list(parts)[::-1], 1, 0, 3)
    return {p: (b[0], b[1], left[p], right[p]) for p, b in parts.items()}


def longest_previous(rows: list, first: list, last: list, left: list, right: list) -> list[int]:
    """For each suffix of a part the most lines that it shares with any earlier place: previous and next smaller places in suffix order, by a stack."""
    best = [0] * len(rows)
    for order, edge, stairs in ((range(len(rows)), first, left), (range(len(rows) - 1, -1, -1), last, right)):
        stack: list[tuple[tuple, int]] = []  # (place, lines shared with the entry below), places rising
        before, with_edge = edge, len(edge)
        for i in order:
            place, hs, _ = rows[i]
            shared = common(before, hs)
            with_edge, before = min(with_edge, shared), hs
            while stack and stack[-1][0] > place:
                shared = min(shared, stack.pop()[1])
            if stack:
                best[i] = max(best[i], shared)
            stack.append((place, shared))
            for n in range(min(with_edge, len(stairs)), best[i], -1):
                if stairs[n - 1] < place:
                    best[i] = n
                    break
    return best


def earlier_copies(found: DataFrame, min_words: int) -> DataFrame:
    """(d, t, j, n): from line j of a document on, n lines of min_words or more words have an earlier copy."""
    order = ["r", "d", "t", "j"]
    found = materialize(found, "heads")
    n = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.count() // PART_ROWS + 1)
    parts = materialize(found.repartitionByRange(n, *order).select(F.spark_partition_id().alias("part"), *found.columns), "order")
    parts = parts.repartition(n, "part").sortWithinPartitions("part", *order).select("part", "d", "t", "j", "hs", "ws")
    edges = carried(parts.mapInArrow(borders, BORDERS).collect())  # one row for each part, of min_words entries at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            best = longest_previous(rows, *edges[part])
            hits = [(*place, b) for (place, _, ws), b in zip(rows, best, strict=True) if b and sum(ws[:b]) >= min_words]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in hits], kind) for k, kind in enumerate(kinds)], names=["d", "t", "j", "n"])

    return parts.mapInArrow(run, "d long, t long, j int, n int")


def cut(text: str | None, runs: list[tuple[int, int]], whole: bool, min_words: int) -> tuple[str, int, int]:
    """The text without its copied lines; how many lines it had, and how many went."""
    text = text or ""
    lines = text.split("\n")
    numbers = [(k, w) for k, _, w in line_parts(text)]
    gone: set[int] = set()
    if whole and sum(w for _, w in numbers) >= min_words:
        gone = {k for k, _ in numbers}
    for j, n in runs or []:
        gone.update(k for k, _ in numbers[j : j + n])
    return ("\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else text), len(lines), len(gone)


def marked(docs: DataFrame, min_words: int, text: str = "text") -> DataFrame:
    """docs (columns c_0, c_1, ...) with _runs, the copied runs of each, and _whole, true for all but the first of equal rows."""
    with scratch() as tables:
        copies = earlier_copies(suffixes(docs, min_words, text), min_words)
        runs = copies.groupBy("d", "t").agg(F.collect_list(F.struct("j", "n")).alias("_runs")).withColumnsRenamed({"d": "_d", "t": "_t"})
        runs = materialize(runs, "runs")
        drop(tables, runs)
    keyed = docs.select(*[F.col(c).alias(f"c_{k}") for k, c in enumerate(docs.columns)], doc_key().alias("_d"), text_key(text).alias("_t"))
    out = keyed.join(runs, ["_d", "_t"], "left")
    every = F.xxhash64(*[f"c_{k}" for k in range(len(docs.columns))])
    return out.withColumn("_whole", F.row_number().over(Window.partitionBy("_d", "_t").orderBy(every)) > 1)


def dedup(docs: DataFrame, min_words: int = MIN_WORDS, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs without their later copies of repeated runs. A document that loses all its lines with words goes; n_chars, if there is such a column, follows the text."""
    columns = docs.columns
    at, size_at = columns.index(text), columns.index(n_chars) if n_chars in columns else None
    schema = T.StructType(docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            own = list(batch.columns[: len(columns)])
            texts, keep, sizes = [], [], own[size_at].to_pylist() if size_at is not None else []
            for k, (old, runs, whole) in enumerate(zip(own[at].to_pylist(), batch.column("_runs").to_pylist(), batch.column("_whole").to_pylist(), strict=True)):
                new, _, gone = cut(old, [(r["j"], r["n"]) for r in runs or []], whole, min_words)
                texts.append(new if gone else old)
                keep.append(not gone or bool(new.strip(SPACES)))
                if gone and sizes:
                    sizes[k] = len(new)
            own[at] = pa.array(texts, pa.string())
            if sizes:
                own[size_at] = pa.array(sizes, own[size_at].type)
            yield pa.RecordBatch.from_arrays(own, names=columns).filter(pa.array(keep, pa.bool_()))

    return marked(docs, min_words, text).select(*[f"c_{k}" for k in range(len(columns))], "_runs", "_whole").mapInArrow(run, schema)


def digests(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and kept_sha256 of what stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [cut(old, [(r["j"], r["n"]) for r in runs or []], whole, min_words) for old, runs, whole in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            shas = [hashlib.sha256(r[0].encode("utf-8", "replace")).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])

    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return marked(both, min_words).select("c_0", "c_1", "_runs", "_whole").mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
