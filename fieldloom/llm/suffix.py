"""Removal of repeated byte strings by longest previous factors.

A byte goes if a string of LENGTH bytes that covers it also starts elsewhere: at any other place, or with keep_first at an earlier one, that is,
where the longest previous factor is LENGTH or more. A full suffix order of every byte moves some hundred bytes per byte of
text through shuffles. Strings of LENGTH bytes are all that counts, so suffixes are compared to that depth, and only where it matters:

1.  Each place of a text has an anchor: the smallest hash of 32 bytes among the SPREAD next places (the last on ties). Anchor and distance
    depend on the string that begins there alone, so equal strings have equal anchors at equal distances. The places of one anchor follow one another
    and form a group, with two hashes: `sig` of the bytes after the anchor that each of its strings holds, `blk` of all bytes that they cover.
2.  Groups meet by sig. A sig seen once has no repeats. If all groups of a sig have one blk, all their strings repeat; places in order tell the first.
3.  Sigs with several blks send the bytes of one group for each blk (the first place that has it), with the number of groups behind it. There the
    suffixes, cut at LENGTH, are put in suffix order, ties by place. Neighbours that share all LENGTH bytes have a longest previous factor of LENGTH: the
    previous smaller place in suffix order is the earlier match. Sigs with very many blks are split by string instead.
4.  Documents with repeats take their spans back.

Texts are compressed while they move. Sigs that hold a thousandth of a sample's groups, at most 1,000 of them, are counted by partial sums and joined
in parts that Spark can split, the others by a window; results are the same. No group is collected.

The corpus is in order of doc_id (where it is null: of a hash of the text), another 64-bit hash of the text, then place. Edge cases: a null text is empty; texts shorter than LENGTH lose nothing; repeated rows are copies
of one another (keep_first keeps both, as they have one place); matches never cross documents; texts of any length are treated whole, long ones in overlapping pieces; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.llm.shared import materialize, release, text_or_empty

LENGTH, GRAM, SPREAD = 200, 32, 150
#: Places of a piece of a long text; blks of a sig that one partition compares; strings that are put in order at once, about; rows of a batch.
PIECE, MANY, TOGETHER, SLICE = 1 << 17, 2000, 1 << 16, 500
#: One document in so many is looked at for sigs that are hot: a thousandth of the groups there, so HOT of them at most, seen LEAST_SEEN times.
SAMPLE, HOT, LEAST_SEEN = 64, 1000, 20
MASK = np.uint64((1 << 18) - 1)


@lru_cache(1)
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and the powers of an odd base and of its inverse, modulo 2^64."""
    base, n = 0x9E3779B97F4A7C15, PIECE + 2 * LENGTH
    letters = np.random.default_rng(42).integers(1, 2**63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
    up, down = np.ones(n, "u8"), np.ones(n, "u8")
    up[1:], down[1:] = np.uint64(base), np.uint64(pow(base, -1, 2**64))
    return letters, np.cumprod(up, dtype="u8"), np.cumprod(down, dtype="u8")


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    letters, up, _ = powers()
    out = np.zeros(len(raw) + 1, "u8")
    np.cumsum(letters[raw] * up[: len(raw)], out=out[1:], dtype="u8")
    return out


def hashes(sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, at: np.ndarray | slice) -> np.ndarray:
    """Hashes of the strings from start to end; `at` is start, for the shift."""
    return mixed((sums[end] - sums[start]) * powers()[2][at])


def groups(raw: bytes) -> np.ndarray:
    """Rows (first place, distance to the anchor, further places, sig, blk) of all groups of a text."""
    data, out = np.frombuffer(raw, "u1"), [np.zeros((0, 5), "i8")]
    for begin in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):
        piece = data[begin : begin + PIECE + LENGTH - 1]
        sums, n = prefix_sums(piece), len(piece) - LENGTH + 1
        seen = n + SPREAD - 1
        near = (hashes(sums, slice(0, seen), slice(GRAM, GRAM + seen), slice(0, seen)) & ~MASK) | (MASK - np.arange(seen, dtype="u8"))
        span = 1
        while 2 * span <= SPREAD:
            near = np.minimum(near[:-span], near[span:])
            span *= 2
        if span < SPREAD:
            near = np.minimum(near[:n], near[SPREAD - span : SPREAD - span + n])
        anchor = (MASK - (near[:n] & MASK)).astype("i8")
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        more = np.append(first[1:], n) - 1 - first
        own = anchor[first]
        sig = hashes(sums, own, own + LENGTH - SPREAD + 1, own)
        blk = mixed(hashes(sums, first, first + more + LENGTH, first) + more.astype("u8") * np.uint64(1000003) + (own - first).astype("u8"))
        out.append(np.stack([first + begin, own - first, more, sig.view("i8"), blk.view("i8")], 1))
    return np.concatenate(out)


KEY = ["d", "t"]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, d, t, raw): d and t are a document's place in the corpus, raw its bytes. Rows without doc_id are told apart by two hashes of the text."""
    raw = text_or_empty(text).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit(7), raw)).alias("d"), F.xxhash64(raw).alias("t"), raw.alias("raw"))


def group_table(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            found = [groups(x.as_py()) for x in batch.column(2)]
            n = [len(f) for f in found]
            rows = np.concatenate([np.zeros((0, 5), "i8"), *found])
            d, t = (np.repeat(batch.column(k).to_numpy(), n) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, t, *(rows[:, k].copy() for k in (0, 2, 3, 4)))], names=["d", "t", "lo", "more", "sig", "blk"])

    return texts.select(*KEY, "raw").mapInArrow(run, "d long, t long, lo long, more long, sig long, blk long")


def hot_sigs(texts: DataFrame) -> list[int]:
    """Sigs that very many groups share, by a sample of documents: HOT at most. They only decide by which plan groups meet."""
    some = materialize(group_table(texts.where(F.pmod(F.xxhash64(F.lit(3), *KEY), F.lit(SAMPLE)) == 0)).groupBy("sig").agg(F.count(F.lit(1)).alias("n")), "sample")
    total = some.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    out = [r["sig"] for r in some.where(F.col("n") >= max(LEAST_SEEN, total / HOT)).limit(HOT).collect()]
    release(some)
    return out


def repeated(texts: DataFrame) -> DataFrame:
    """Groups whose sig occurs twice or more, with c (groups of the same blk), head (whether it is the first of them in corpus order) and many (whether the sig has several blks)."""
    found, hot = group_table(texts), hot_sigs(texts)
    place = F.struct(*KEY, "lo")
    same, sig = Window.partitionBy("sig", "blk"), Window.partitionBy("sig")
    out = found.where(~F.col("sig").isin(hot)) if hot else found
    out = out.withColumns({"c": F.count(F.lit(1)).over(same), "_first": F.min(place).over(same)}).withColumns({"_n": F.count(F.lit(1)).over(sig), "_a": F.min("blk").over(sig), "_b": F.max("blk").over(sig)})
    if hot:
        own = materialize(found.where(F.col("sig").isin(hot)), "hot")
        by_blk = materialize(own.groupBy("sig", "blk").agg(F.count(F.lit(1)).alias("c"), F.min(place).alias("_first")), "by-blk")
        by_sig = materialize(by_blk.groupBy("sig").agg(F.sum("c").alias("_n"), F.min("blk").alias("_a"), F.max("blk").alias("_b")), "by-sig")  # HOT rows at most
        out = out.unionByName(own.join(by_blk, ["sig", "blk"]).join(F.broadcast(by_sig), "sig").select(*out.columns))
    return out.where("_n > 1").select(*KEY, "lo", "more", "sig", "blk", "c", (place == F.col("_first")).alias("head"), (F.col("_a") != F.col("_b")).alias("many"))


OPEN = pa.struct([("lo", pa.int64()), ("head", pa.bool_()), ("sig", pa.int64()), ("blk", pa.int64())])
ARROW = pa.schema([("doc_id", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("z", pa.binary()), ("whole", pa.list_(pa.int64())), ("open", pa.list_(OPEN)), ("sig", pa.int64()), ("blk", pa.int64()), ("c", pa.int64()), ("lo", pa.int64()), ("ctx", pa.binary())])
PACKED = "doc_id long, d long, t long, z binary, whole array<bigint>, open array<struct<lo:bigint,head:boolean,sig:bigint,blk:bigint>>, sig long, blk long, c long, lo long, ctx binary"


def listed(values: pa.Array, of: np.ndarray, n: int, each: int = 1) -> pa.ListArray:
    """Lists of n rows from their values, in order; of: the row of each (of every `each` values)."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n) * each)]).astype("i4")), values)


def padded(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in ARROW], schema=ARROW)


def unpacked(keep_first: bool) -> Callable:
    """Per document its text, the places settled (pairs of first place and number) and open groups; and for open groups that stand for their blk, the bytes they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, last = zstandard.ZstdDecompressor(), None
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            n, lists = batch.num_rows, batch.column("groups")
            of, g = np.repeat(np.arange(n), lists.value_lengths().to_numpy()), lists.flatten()
            lo, more, c, sig, blk = (g.field(k).to_numpy(zero_copy_only=False) for k in ("lo", "more", "c", "sig", "blk"))
            head, many = (g.field(k).to_numpy(zero_copy_only=False).astype(bool) for k in ("head", "many"))
            whole = ~many & ~head if keep_first else ~many
            pairs = np.stack([lo[whole], more[whole] + 1], 1).ravel()
            open_ = pa.StructArray.from_arrays([pa.array(x[many]) for x in (lo, head, sig, blk)], fields=list(OPEN))
            yield padded({k: batch.column(k) for k in ("doc_id", *KEY, "z")} | {"whole": listed(pa.array(pairs), of[whole], n, 2), "open": listed(open_, of[many], n)}, n)
            # of rows that are equal one sends its bytes
            d, t = (batch.column(k).to_numpy() for k in KEY)
            fresh = np.ones(n, bool)
            fresh[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
            fresh[0] = (d[0], t[0]) != last
            last = (d[-1], t[-1])
            send = np.flatnonzero(many & head & fresh[of])
            ctx, at = [], -1
            for k in send.tolist():
                if of[k] != at:
                    at = of[k]
                    raw = unpack.decompress(batch.column("z")[int(at)].as_py())
                ctx.append(raw[lo[k] : lo[k] + more[k] + LENGTH])
            if ctx:
                yield padded({"sig": pa.array(sig[send]), "blk": pa.array(blk[send]), "c": pa.array(c[send]), "d": pa.array(d[of[send]]), "t": pa.array(t[of[send]]), "lo": pa.array(lo[send]), "ctx": pa.array(ctx, pa.binary())}, len(ctx))

    return run


def string_hashes(contexts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every string of LENGTH bytes of each context, which context it is of, and its place there."""
    parts = [hashes(s := prefix_sums(np.frombuffer(c, "u1")), slice(0, n := len(c) - LENGTH + 1), slice(LENGTH, None), slice(0, n)) for c in contexts]
    sizes = [len(p) for p in parts]
    return np.concatenate([np.zeros(0, "u8"), *parts]), np.repeat(np.arange(len(parts)), sizes), np.concatenate([np.zeros(0, "i8"), *map(np.arange, sizes)])


def runs_of(flags: np.ndarray, of: np.ndarray, at: np.ndarray, n: int) -> pa.ListArray:
    """Runs of flagged places (pairs of first and number) of each of n contexts."""
    own, place = of[flags], at[flags]
    first = np.ones(len(own), bool)
    first[1:] = (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)
    begins = np.flatnonzero(first)
    return listed(pa.array(np.stack([place[begins], np.diff(np.append(begins, len(own)))], 1).ravel()), own[begins], n, 2)


def in_suffix_order(rows: list[tuple]) -> pa.RecordBatch:
    """What settle() gives for rows (sig, blk, c, d, t, lo, ctx) of whole sigs."""
    sig, blk, c, d, t, lo = (np.array([r[k] for r in rows], "i8") for k in range(6))
    size = np.array([len(r[6]) for r in rows]) - LENGTH + 1
    of = np.repeat(np.arange(len(rows)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    place = np.empty(len(rows), "i8")
    place[np.lexsort((lo, t, d))] = np.arange(len(rows))
    by_place = np.lexsort((at, place[of]))
    # each suffix, cut at LENGTH, behind the number of its sig
    text = np.empty((len(of), 4 + LENGTH), "u1")
    number = np.unique(sig, return_inverse=True)[1].astype(">u4")
    text[:, :4] = number[of].view("u1").reshape(-1, 4)
    for k, row in enumerate(rows):
        end = int(size[: k + 1].sum()) if k == 0 else end + int(size[k])
        text[end - size[k] : end, 4:] = np.lib.stride_tricks.sliding_window_view(np.frombuffer(row[6], "u1"), LENGTH)
    order = by_place[np.argsort(text.view(f"S{4 + LENGTH}").ravel()[by_place], kind="stable")]
    shared = np.zeros(len(order), bool)  # whether the longest common prefix with the suffix before is LENGTH
    shared[1:] = (text[order[1:]] == text[order[:-1]]).all(1)
    run = np.cumsum(~shared) - 1
    twice = np.bincount(run, weights=c[of[order]]) > 1
    again, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    again[order], later[order] = twice[run], shared  # ties stand by place: the one before is the previous smaller place
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(blk), *(runs_of(flags, of, at, len(rows)) for flags in (again, later))], names=["sig", "blk", "any", "later"])


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sig, blk, any, later): runs of places of a blk whose string occurs twice or more, and of those whose string has an earlier match. Rows come by sig."""
    rows, held = [], 0
    for batch in batches:
        for row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if held > TOGETHER and row[0] != rows[-1][0]:
                yield in_suffix_order(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[6]) - LENGTH + 1
    if rows:
        yield in_suffix_order(rows)


def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every string of each context, for sigs with very many blks."""
    for batch in batches:
        h, of, at = string_hashes(batch.column("ctx").to_pylist())
        own = [batch.column(k).to_numpy()[of] for k in ("sig", "blk", "c", "d", "t", "lo")]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, h.view("i8"), at)], names=["sig", "blk", "c", "d", "t", "lo", "h", "at"])


def settled(contexts: DataFrame) -> DataFrame:
    contexts = materialize(contexts.dropDuplicates(["sig", "blk"]), "contexts")
    sizes = materialize(contexts.groupBy("sig").agg(F.count(F.lit(1)).alias("_m")), "sizes")
    n = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["sig", "blk", "c", "d", "t", "lo", "ctx"]
    small = contexts.join(sizes.where(F.col("_m") <= MANY), "sig").select(*columns).repartition(n, "sig").sortWithinPartitions("sig").mapInArrow(settle, "sig long, blk long, any array<bigint>, later array<bigint>")
    every = contexts.join(F.broadcast(sizes.where(F.col("_m") > MANY)) if sizes.where(F.col("_m") > MANY).count() <= HOT else sizes.where(F.col("_m") > MANY), "sig").select(*columns)
    every = materialize(every.mapInArrow(strings, "sig long, blk long, c long, d long, t long, lo long, h long, at long"), "strings")
    sums = materialize(every.groupBy("sig", "h").agg(F.sum("c").alias("_c"), F.min(F.struct("d", "t", "lo", "at")).alias("_first")).where("_c > 1"), "sums")
    marked = every.join(sums, ["sig", "h"])
    one = F.array(F.col("at"), F.lit(1).cast("long"))
    large = marked.groupBy("sig", "blk").agg(F.flatten(F.collect_list(one)).alias("any"), F.flatten(F.collect_list(F.when(F.struct("d", "t", "lo", "at") > F.col("_first"), one))).alias("later"))
    return small.unionByName(large).where("size(any) > 0")


def covered(size: int, whole: list[int], places: Iterator[tuple[int, list[int]]]) -> np.ndarray:
    """Which bytes of a text are covered by a string that starts in a run of settled places or in one of `places` (base, runs)."""
    runs = np.concatenate([np.array(whole, "i8"), *(np.array(p, "i8") + np.tile([base, 0], len(p) // 2) for base, p in places)]).reshape(-1, 2)
    marks = np.bincount(runs[:, 0], minlength=size + 1).astype("i8") - np.bincount(runs[:, 0] + runs[:, 1] - 1 + LENGTH, minlength=size + 1)
    return np.cumsum(marks[:-1]) > 0


def removals(docs: DataFrame, out: Callable, schema: str, keep_first: bool = False, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """out(doc_id, raw, covered) of every document with repeats, and the (d, t) of those documents."""
    texts = keyed(docs, text)
    kept = lambda c: F.when(F.col("many"), F.col(c)).otherwise(F.lit(0).cast("long")).alias(c)
    lists = repeated(texts).groupBy(*KEY).agg(F.collect_set(F.struct("lo", "more", "head", "c", "many", kept("sig"), kept("blk"))).alias("groups"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            raws = batch.column(3).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([pack.compress(x) for x in raws], pa.binary())], names=["doc_id", "d", "t", "z"])

    small = texts.mapInArrow(packed, "doc_id long, d long, t long, z binary")
    table = materialize(small.join(lists, KEY).select("doc_id", *KEY, "z", "groups").mapInArrow(unpacked(keep_first), PACKED), "repeats")
    pending = table.where("ctx IS NULL").select("doc_id", *KEY, "z", "whole", "open")
    contexts = table.where("ctx IS NOT NULL").select("sig", "blk", "c", *KEY, "lo", "ctx")
    answers = materialize(settled(contexts), "answers")
    asked = pending.select(*KEY, F.explode("open").alias("o")).select(*KEY, "o.lo", "o.head", "o.sig", "o.blk")
    # of a blk's groups all but the first have an earlier match at every place
    wanted = F.when(F.col("head"), F.col("later")).otherwise(F.col("any")) if keep_first else F.col("any")
    told = asked.join(answers, ["sig", "blk"]).select(*KEY, "lo", wanted.alias("at")).groupBy(*KEY).agg(F.collect_set(F.struct("lo", "at")).alias("places"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            rows = []
            for row in batch.to_pylist():
                raw = unpack.decompress(row["z"])
                rows.append(out(row["doc_id"], raw, covered(len(raw), row["whole"], ((p["lo"], p["at"]) for p in row["places"] or []))))
            yield from pa.Table.from_pylist(rows, schema=arrow_schema(schema)).to_batches() if rows else []

    done = pending.join(told, KEY, "left").select("doc_id", "z", "whole", "places").mapInArrow(finish, schema)
    return done, pending.select(*KEY).distinct()


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<array<bigint>>": pa.list_(pa.list_(pa.int64()))}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.strip().split(" ") for x in ddl.split(","))])


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def edges(gone: np.ndarray) -> np.ndarray:
    """Pairs of start and end of the runs of a mask."""
    return np.flatnonzero(np.diff(np.concatenate([[0], gone.astype("i1"), [0]]))).reshape(-1, 2)


def digest(doc_id: int | None, raw: bytes, gone: np.ndarray) -> dict:
    kept = np.frombuffer(raw, "u1")[~gone].tobytes()
    return {"doc_id": doc_id, "n_bytes": len(raw), "n_removed": int(gone.sum()), "n_spans": len(edges(gone)), "kept_sha256": hashlib.sha256(kept).hexdigest()}


def digests(docs: DataFrame, keep_first: bool = False, text: str = "text") -> DataFrame:
    """What every document loses: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    done, keys = removals(docs, digest, DIGEST, keep_first, text)
    zero = F.lit(0).cast("long")
    rest = keyed(docs, text).select("doc_id", *KEY, F.octet_length("raw").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("raw", 256).alias("kept_sha256")).join(keys, KEY, "left_anti")
    return done.unionByName(rest.drop(*KEY))


def spans(docs: DataFrame, keep_first: bool = True, text: str = "text") -> DataFrame:
    """(doc_id, spans): start and end in bytes of what documents with repeats lose."""
    row = lambda doc_id, raw, gone: {"doc_id": doc_id, "spans": edges(gone).tolist()}
    return removals(docs, row, "doc_id long, spans array<array<bigint>>", keep_first, text)[0]
