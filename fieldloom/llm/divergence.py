"""Source divergence audit: term counts of each source against its language, over a vocabulary held in minimal acyclic transducers.

1.  Documents that hold a term are counted by language; terms in LEAST_DOCS documents or more are kept.
2.  Kept terms are sorted by language and bytes, and numbered in that order. Each range of the order, of a bounded number of terms, makes one minimal
    acyclic transducer: a word's path adds up to its number among the range's words.
3.  Texts stream through the transducers for the recount. Transducers of HELD terms at most are sent to the tasks together; a larger vocabulary takes as many
    passes over the texts as that needs. What a task finds is summed by language, source and number before it moves.
4.  Shares p and divergences f are exact whole numbers. A language's terms are dealt in blocks of numbers; a block has a row of counts for each term and
    adds up f for all pairs of sources at once, so no pairs of rows are ever made. The terms of a source rank by f, ties by number, which is the order of their bytes.

A term is a run of ASCII letters and characters beyond ASCII, with A-Z lower-cased. Edge cases: null text, lang or source is ''; rows with equal doc_id, or without one, are documents of their own;
groups without terms and languages without kept terms have their pairs, with value 0 where nothing is kept; an empty table gives an empty table; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.runs import byte_class, runs, slices
from fieldloom.llm.shared import materialize, small, text_or_empty

LEAST_DOCS, SMOOTH, UNIT, TOP = 10, 2, 1_000_000_000, 10
#: Terms of one transducer, about (some 20 bytes each), and of all that are sent together; terms of a block.
TERMS, HELD, BLOCK = 1 << 19, 1 << 21, 1 << 10
LETTERS = byte_class(lambda b: b >= 0x80 or chr(b).isalpha())
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], "u1")


class Transducer:
    """A minimal acyclic automaton over sorted keys; `ordinals` maps keys to their numbers in that order."""

    def __init__(self, start: int, key: np.ndarray, to: np.ndarray, plus: np.ndarray, final: np.ndarray):
        self.start, self.key, self.to, self.plus, self.final = start, key, to, plus, final

    @classmethod
    def of(cls, keys: list[bytes]) -> Transducer:
        """From sorted, distinct keys: the path of each new key shares what it can with the one before; what is left of that is merged with equal states."""
        known: dict[tuple, int] = {}
        arcs: list[tuple[tuple[int, int], ...]] = []
        finals: list[bool] = []
        open_: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
        labels: list[int] = []

        def close(depth: int) -> None:
            while len(labels) > depth:
                final, out = open_.pop()
                state = (final, tuple(out))
                at = known.get(state)
                if at is None:
                    at = known[state] = len(arcs)
                    arcs.append(state[1])
                    finals.append(final)
                open_[-1][1].append((labels.pop(), at))

        for key in keys:
            shared = 0
            for a, b in zip(labels, key, strict=False):
                if a != b:
                    break
                shared += 1
            close(shared)
            for b in key[shared:]:
                labels.append(b)
                open_.append((False, []))
            open_[-1] = (True, open_[-1][1])
        close(0)
        arcs.append(tuple(open_[0][1]))
        finals.append(open_[0][0])
        words, key_, to, plus = [], [], [], []
        for s, (out, final) in enumerate(zip(arcs, finals, strict=True)):  # targets come before their sources
            n = int(final)
            for b, q in out:
                key_.append(s << 8 | b)
                to.append(q)
                plus.append(n)
                n += words[q]
            words.append(n)
        return cls(len(arcs) - 1, np.array(key_, "i8"), np.array(to, "i4"), np.array(plus, "i4"), np.array(finals, bool))

    def pack(self) -> tuple[int, bytes, bytes, bytes, bytes]:
        return self.start, self.key.tobytes(), self.to.tobytes(), self.plus.tobytes(), self.final.tobytes()

    @classmethod
    def unpack(cls, start: int, *arrays: bytes) -> Transducer:
        return cls(start, *(np.frombuffer(a, kind) for a, kind in zip(arrays, ("i8", "i4", "i4", bool), strict=True)))

    def lead(self, prefix: bytes) -> tuple[int, int]:
        """The state after a prefix (-1 for none), and what its path adds up to."""
        state, number = self.start, 0
        for b in prefix:
            at = int(np.searchsorted(self.key, state << 8 | b))
            if at == len(self.key) or self.key[at] != state << 8 | b:
                return -1, 0
            state, number = int(self.to[at]), number + int(self.plus[at])
        return state, number

    def walk(self, state: np.ndarray, number: np.ndarray, words: pa.Array) -> np.ndarray:
        """The numbers of words read from the given states and numbers on; -1 for those that lead nowhere (or begin at state -1)."""
        starts = np.frombuffer(words.buffers()[1], "i4", len(words) + 1).astype("i8")
        data, sizes = np.frombuffer(words.buffers()[2] or b"", "u1"), np.diff(starts)
        state, number = state.astype("i8"), number.astype("i8")
        live = np.flatnonzero((state >= 0) & (sizes > 0))
        k = 0
        while len(live) and len(self.key):
            key = state[live] << 8 | data[starts[live] + k]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            found = self.key[at] == key
            state[live[~found]] = -1
            live, at = live[found], at[found]
            number[live] += self.plus[at]
            state[live] = self.to[at]
            k += 1
            live = live[sizes[live] > k]
        ended = state >= 0
        ended[ended] = self.final[state[ended]]
        return np.where(ended & (sizes > 0), number, -1)


def rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], text_or_empty("text").alias("_text"))


def coded(*columns: pa.Array) -> tuple[np.ndarray, list[tuple]]:
    """A number for each row's combination of values, and the combinations."""
    known: dict[tuple, int] = {}
    at = [known.setdefault(x, len(known)) for x in zip(*(c.to_pylist() for c in columns), strict=True)]
    return np.array(at, "i8"), list(known)


def document_counts(texts: DataFrame) -> DataFrame:
    """(lang, term, n): documents of the language with the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            words, n = runs(batch.column(1), LETTERS, LOWER)
            terms, (lang, langs) = words.dictionary_encode(), coded(batch.column(0))
            doc = np.repeat(np.arange(len(n)), n)
            pairs = np.unique(terms.indices.to_numpy().astype("i8") * len(n) + doc)  # a term counts once in a document
            own, counts = np.unique(pairs // len(n) * len(langs) + lang[pairs % len(n)], return_counts=True)
            names = pa.array([x for (x,) in langs], pa.string()).take(pa.array(own % len(langs)))
            yield pa.RecordBatch.from_arrays([names, terms.dictionary.cast(pa.string()).take(pa.array(own // len(langs))), pa.array(counts)], names=["lang", "term", "n"])

    return texts.select("lang", "_text").mapInArrow(run, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def vocabulary(texts: DataFrame, least: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """(id, lang, term): kept terms; ids grow with language and bytes, and count on within a range, whose number is id >> 33."""
    key = F.concat(F.col("lang").cast("binary"), F.lit(b"\x00"), F.col("term").cast("binary"))  # a term has no zero, so the last one parts them
    kept = materialize(document_counts(texts).where(F.col("n") >= least).select("lang", "term", key.alias("key")), "kept")
    ranges = max(1, -(-kept.count() // terms))
    return materialize(kept.repartitionByRange(ranges, "key").sortWithinPartitions("key").withColumn("id", F.monotonically_increasing_id()), "vocabulary")


def transducers(vocab: DataFrame) -> DataFrame:
    """(shard, n, start, key, to, plus, final): a packed transducer for each range of the vocabulary."""

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        keys = table["key"].to_pylist()
        machine = Transducer.of(keys)
        return pa.table([[table["id"][0].as_py() >> 33], [len(keys)], *([x] for x in machine.pack())], names=["shard", "n", "start", "key", "to", "plus", "final"])

    built = vocab.select("id", "key").groupBy(F.shiftright("id", 33)).applyInArrow(build, "shard long, n long, start long, key binary, to binary, plus binary, final binary")
    return materialize(built, "transducers")


def recount(texts: DataFrame, machines: DataFrame, held: int = HELD) -> DataFrame:
    """(lang, source, id, n): occurrences of kept terms in the texts of each group, by streaming all texts through the transducers."""
    passes, room = [[]], held
    for shard, n in sorted((r["shard"], r["n"]) for r in machines.select("shard", "n").collect()):  # one row for each TERMS terms
        if n > room and passes[-1]:
            passes.append([])
            room = held
        passes[-1].append(shard)
        room -= n
    out = None
    for shards in passes:
        sent = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in machines.where(F.col("shard").isin(shards)).select("shard", "start", "key", "to", "plus", "final").collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held = [(shard, Transducer.unpack(*packed)) for shard, *packed in sent.value]
            for batch in slices(batches, 2):
                words, n = runs(batch.column(2), LETTERS, LOWER)
                group, groups = coded(batch.column(0), batch.column(1))
                langs = {x: k for k, x in enumerate(dict.fromkeys(lang for lang, _ in groups))}
                lang_of = np.array([langs[lang] for lang, _ in groups], "i8")
                own = np.repeat(group, n)
                terms = words.dictionary_encode()
                # occurrences of one term in one group meet, and go through together
                pairs, counts = np.unique(terms.indices.to_numpy().astype("i8") * max(len(groups), 1) + own, return_counts=True)
                term, own = pairs // max(len(groups), 1), pairs % max(len(groups), 1)
                names = [pa.array([x[k] for x in groups], pa.string()) for k in (0, 1)]
                streamed = terms.dictionary.take(pa.array(term))
                for shard, machine in held:
                    state, number = np.array([machine.lead(x.encode("utf-8", "replace") + b"\x00") for x in langs], "i8").reshape(-1, 2).T
                    found = machine.walk(state[lang_of[own]], number[lang_of[own]], streamed)
                    hit = np.flatnonzero(found >= 0)
                    yield pa.RecordBatch.from_arrays([*(x.take(pa.array(own[hit])) for x in names), pa.array(found[hit] + (shard << 33)), pa.array(counts[hit])], names=["lang", "source", "id", "n"])

        found = texts.select("lang", "source", "_text").mapInArrow(run, "lang string, source string, id long, n long")
        out = found if out is None else out.unionByName(found)
    return materialize(out.groupBy("lang", "source", "id").agg(F.sum("n").alias("n")), "counts")


def share(count, total):
    """p of a term with `count` occurrences; exact in decimals, whatever the counts. total: N + 2 V."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", (wide(count) + SMOOTH) * F.lit(UNIT).cast("decimal(10,0)"), wide(total))


def exact_shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """share() of a matrix of counts whose columns have these totals."""
    if len(counts) and counts.max() >= 2**63 // UNIT - SMOOTH:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + UNIT * (counts + SMOOTH) // totals).astype("i8")


def block_pairs(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
    """(lang, a, b, f): f summed over a block's terms for all ordered pairs of a language's sources. counts: (id, source, n); groups: (source, total) of all of them."""
    names = groups["source"].to_pylist()
    at = {s: k for k, s in enumerate(names)}
    column = np.array([at[s] for s in counts["source"].to_pylist()], "i8")
    row = np.unique(counts["id"].to_numpy(), return_inverse=True)[1]
    matrix = np.zeros((int(row.max(initial=-1)) + 1, len(names)), "i8")
    matrix[row, column] = counts["n"].to_numpy()
    p = exact_shares(matrix, groups["total"].to_numpy())
    f = np.zeros((len(names), len(names)), "i8")
    for k in range(len(names)):
        f[k] = ((p - p[:, k : k + 1]) ** 2 // (p + p[:, k : k + 1])).sum(0)
    a, b = np.nonzero(f)
    lang = key[0].as_py()
    named = pa.array(names, pa.string())
    return pa.table([pa.array([lang] * len(a), pa.string()), named.take(pa.array(a)), named.take(pa.array(b)), pa.array(f[a, b])], names=["lang", "a", "b", "f"])


def audit(docs: DataFrame, least: int = LEAST_DOCS, terms: int = TERMS, held: int = HELD, block: int = BLOCK, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: divergence of each source from the others of its language (part pair), and the terms it has most more of than its language (part term)."""
    texts = rows(docs)
    vocab = vocabulary(texts, least, terms)
    counts = recount(texts, transducers(vocab), held)
    size = vocab.groupBy("lang").agg(F.count(F.lit(1)).alias("_v"))
    total = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("_n"))
    with_total = lambda df: df.withColumn("total", F.coalesce("_n", F.lit(0)) + 2 * F.coalesce("_v", F.lit(0))).drop("_n", "_v")
    groups = with_total(texts.select("lang", "source").distinct().join(total(counts, "lang", "source"), ["lang", "source"], "left").join(size, "lang", "left"))
    groups = small(materialize(groups, "groups"))  # as a join by language or source would bring a common one into one task
    whole = materialize(counts.groupBy("lang", "id").agg(F.sum("n").alias("_n_lang")), "whole")
    langs = with_total(total(whole.withColumnRenamed("_n_lang", "n"), "lang").join(size, "lang")).withColumnRenamed("total", "_total_lang")
    langs = small(materialize(langs, "langs"))

    blocks = counts.withColumn("_block", F.floor(F.col("id") / block))
    sent = blocks.select("lang", "_block").distinct().join(groups, "lang").withColumnsRenamed({"lang": "_lang", "_block": "_sent"})
    f = blocks.groupBy("lang", "_block").cogroup(sent.groupBy("_lang", "_sent")).applyInArrow(block_pairs, "lang string, a string, b string, f long")
    summed = f.groupBy("lang", "a", "b").agg(F.sum("f").alias("_f")).withColumnsRenamed({"a": "source", "b": "item"})
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(summed, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("_f", F.lit(0)).cast("long").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))

    both = counts.join(whole, ["lang", "id"]).join(groups, ["lang", "source"]).join(langs, "lang")
    both = both.withColumns({"_p": share(F.col("n"), F.col("total")), "_q": share(F.col("_n_lang"), F.col("_total_lang"))}).where("_p > _q")
    value = F.call_function("div", (F.col("_p") - F.col("_q")) * (F.col("_p") - F.col("_q")), F.col("_p") + F.col("_q"))
    best = both.select("lang", "source", "id", value.alias("value"))
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "id"))).where(F.col("rank") <= top)
    best = best.join(vocab.select("id", F.col("term").alias("item")), "id").select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(best)
