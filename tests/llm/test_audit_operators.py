"""Whitening, the divergence audit and substring dedup against brute force, planted cases and odd rows."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fieldloom.llm import automata, divergence, runs, shared, whitening

# runs


def test_runs_stay_inside_texts():
    texts = pa.array(["ab c", "", "d", None, " e\tf\x1cg ", "é x"]).fill_null("")
    words, n = runs.runs(texts, runs.WORDS)
    assert words.to_pylist() == [x.encode() for x in ("ab", "c", "d", "e", "f\x1cg", "é x")] and n.tolist() == [2, 0, 1, 0, 2, 1]
    again, m = runs.runs(texts.slice(2, 3), runs.WORDS)
    assert again.to_pylist() == [b"d", b"e", b"f\x1cg"] and m.tolist() == [1, 0, 2]
    assert [b.num_rows for b in runs.slices([pa.record_batch([pa.array(["x" * 10] * 5)], names=["t"])], 0)] == [5]
    assert runs.runs(pa.array([], pa.string()), runs.WORDS)[1].tolist() == []


# whitening


@pytest.mark.parametrize("kind", ["full", "pairs", "equal", "low rank", "one large", "diagonal"])
@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_divide_and_conquer_finds_eigenvectors(n, kind):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    a = a @ a.T
    a = {"full": a, "pairs": np.diag(np.arange(n) // 2 + 1.0), "equal": 3 * np.eye(n), "low rank": np.outer(a[0], a[0]), "one large": a + 1e7 * np.outer(a[0], a[0]), "diagonal": np.diag(np.arange(n) * 1.0)}[kind]
    k = min(8, n)
    e, v = whitening.leading(a, k)
    size = max(np.linalg.norm(a), 1)
    assert np.allclose(e, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-12 * size)
    assert np.abs(a @ v - v * e).max() < 1e-11 * size and np.abs(v.T @ v - np.eye(k)).max() < 1e-12


def test_polar_is_the_matrix_sign():
    a = np.diag([5.0, 1e-6, -1e-3, -7.0])
    assert np.allclose(whitening.polar(a), np.diag([1, 1, -1, -1]))


def test_whitening_matches_plain_eigenvectors(spark):
    rng = np.random.default_rng(5)
    c = (rng.normal(size=(300, 12)) * np.arange(1, 13)).astype("f4")
    odd = [(900, None, 1), (901, [None] + [1.0] * 11, 1), (902, [float("nan")] + [1.0] * 11, 1), (903, [float("inf")] * 12, 1), (904, [1e30] * 12, 1), (905, [], 1), (906, [1.0] * 11, 1)]
    rows = [(k, x.tolist(), 1) for k, x in enumerate(c)] + [(None, c[0].tolist(), 2), (1, c[1].tolist(), 2)] + odd
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int").selectExpr("*", "'x' AS _w", "0 AS deviation")
    got = whitening.report(df.repartition(5)).toPandas()
    used = np.array([r[1] for r in rows[:302]], "f4").astype("f8")
    x = np.floor(1024 * used).astype("i8") + 100000
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, v = np.linalg.eigh(y.T @ y / n)
    e, v = e[::-1], v[:, ::-1]
    w = (y @ v[:, :8]) / np.sqrt(e[:8])
    assert len(got) == 302 * 8 and set(got["n"]) == {n} and set(got["component"]) == set(range(1, 9)) and got["identity_error"].max() < 1e-9
    assert not set(got["vec_id"].dropna()) & set(range(900, 907))
    for k in range(8):
        own = got[(got["component"] == k + 1) & got["vec_id"].between(2, 299)].sort_values("vec_id")
        a = own["whitened"].to_numpy()
        assert min(np.abs(a - w[2:300, k]).max(), np.abs(a + w[2:300, k]).max()) < 1e-9
        assert own["explained"].iloc[0] == pytest.approx(e[k] / e.sum(), rel=1e-9)
        assert own["deviation"].tolist() == ((n * x - s) ** 2).sum(1)[2:300].tolist()


def test_whitening_without_spread_or_rows(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(4)], "vec_id long, embedding array<float>")
    got = whitening.report(df).collect()
    assert len(got) == 8 and all(r["whitened"] is None and r["deviation"] == 0 and r["explained"] is None for r in got)
    assert whitening.report(df.where("vec_id < 0")).collect() == []
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(9)], "vec_id long, embedding array<float>")
    flat = whitening.report(line).toPandas().groupby("component")["whitened"].count()
    assert flat.tolist() == [9, 0, 0]
    wide = spark.createDataFrame([(k, [float(k) * 2.0**37, 1.0]) for k in range(9)], "vec_id long, embedding array<double>")
    assert any(r["deviation"] is None for r in whitening.report(wide).collect())


# divergence


def test_transducer_numbers_sorted_keys_and_is_minimal():
    rng = random.Random(3)
    keys = sorted({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(400)})
    machine = divergence.Transducer.unpack(*divergence.Transducer.of(keys).pack())
    others = [b"", b"abd", keys[0] + b"zz", *(k + b"c" for k in keys[:50])]
    words = pa.array([*keys, *others], pa.binary())
    n = np.zeros(len(words), "i8")
    want = {k: i for i, k in enumerate(keys)}
    assert machine.walk(n + machine.start, n, words).tolist() == [want.get(w, -1) for w in words.to_pylist()]
    tails = {frozenset(k[len(p) :] for k in keys if k.startswith(p)) for p in {k[:i] for k in keys for i in range(len(k) + 1)}}
    assert len(machine.final) == len(tails)  # as many states as there are different continuations
    assert machine.lead(b"zz") == (-1, 0)
    empty = divergence.Transducer.of([])
    assert empty.walk(n, n, words).tolist() == [-1] * len(words)


def brute_audit(rows, least):
    term, low = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source, found = lang or "", source or "", [m.translate(low) for m in term.findall(text or "")]
        groups.add((lang, source))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        counts[lang].update(found)
    kept = {lang: [m for m, c in docs[lang].items() if c >= least] for lang, _ in groups}

    def p(group, lang):
        total = sum(counts[group][m] for m in kept[lang]) + 2 * len(kept[lang])
        return {m: 1 + 10**9 * (counts[group][m] + 2) // total for m in kept[lang]}

    f, out = lambda a, b: (a - b) ** 2 // (a + b), []
    for lang, source in groups:
        own, whole = p((lang, source), lang), p(lang, lang)
        others = [(-sum(f(own[m], q) for m, q in p((lang, o), lang).items()), o) for k, o in groups if k == lang and o != source]
        terms = [(-f(own[m], whole[m]), m) for m in kept[lang] if counts[lang, source][m] and own[m] > whole[m]]
        for part, found in (("pair", others), ("term", terms)):
            found = sorted(found, key=lambda x: (x[0], x[1].encode()))[: 10 if part == "term" else None]
            out += [(lang, source, part, item, -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("how", [{}, {"terms": 7, "held": 10, "block": 3}])
def test_audit_matches_brute_force(spark, odd_docs, how):
    rng = random.Random(8)
    vocabulary = ["Das", "der", "the", "of", "Äpfel", "äpfel", "a", "b", "ab", "naïve", "x́", "\U0001f469", "Zoo", "zoo", "z"]
    rows = [(rng.choice(["de", "en", None, "d\x00e"]), rng.choice(["s1", "s2", "", None, "S3"]), " ".join(rng.choices(vocabulary, range(1, 16), k=rng.randint(0, 30)))) for _ in range(200)]
    rows += [("xx", "lonely", "seldom"), ("xx", "other", None), *((r["lang"], r["source"], r["text"]) for r in odd_docs.collect())]
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS n", "2 AS id", "3 AS term", "4 AS total")
    got = sorted(tuple(r) for r in divergence.audit(df.repartition(3), least=4, **how).collect())
    assert got == brute_audit(rows, 4)
    assert any(r[0] == "xx" and r[4] == 0 for r in got)


def test_audit_of_nothing_and_large_counts(spark, no_docs):
    assert divergence.audit(no_docs).collect() == []
    n, total = 20_000_000_000, 70_000_000_001
    wide = spark.createDataFrame([(n, total)], "n long, total long")
    want = 1 + 10**9 * (n + 2) // total
    assert wide.select(divergence.share(wide["n"], wide["total"])).first()[0] == want
    assert divergence.exact_shares(np.array([[n]]), np.array([total])).tolist() == [[want]]


# substrings


def brute_windows(rows):
    place = lambda d: -(2**63) if d is None else d
    first, texts = {}, [(d, (x or "").encode().split()) for d, x in rows]
    for d, w in texts:
        for i in range(len(w) - 12):
            k = tuple(w[i : i + 13])
            first[k] = min(first.get(k, place(d)), place(d))
    out = []
    for d, w in texts:
        off = set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < place(d):
                off.update(range(i, i + 13))
        out.append((d, len(w), len(off), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in off)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("alphabet", [2, 5, 60])
def test_automaton_tells_first_documents(alphabet):
    rng = random.Random(alphabet)
    sequences = [[rng.randrange(alphabet) for _ in range(rng.randint(13, 30))] for _ in range(40)]
    sequences += [s[rng.randrange(5) :] for s in sequences[:20]] + sequences[:5]
    docs = [rng.randrange(1000) for _ in sequences]
    machine = automata.Automaton(sequences, docs, alphabet)
    queries = [s[:20] for s in sequences] + [[rng.randrange(alphabet) for _ in range(40)] for _ in range(30)]
    n = np.array([len(q) for q in queries])
    table = np.zeros((len(queries), n.max()), "i8")
    for k, q in enumerate(queries):
        table[k, : len(q)] = q
    first = {}
    for s, d in zip(sequences, docs, strict=True):
        for i in range(len(s) - 12):
            first[tuple(s[i : i + 13])] = min(d, first.get(tuple(s[i : i + 13]), d))
    want = [[first.get(tuple(q[k - 12 : k + 1]), automata.NEVER) if k >= 12 and k < len(q) else automata.NEVER for k in range(table.shape[1])] for q in queries]
    assert machine.matched(table, n).tolist() == want


def test_pieces_hang_on_the_windows_alone(monkeypatch):
    rng = random.Random(4)
    words = [str(rng.randrange(50)) for _ in range(300)]

    def windows(texts):
        found, n = runs.runs(pa.array([" ".join(t) for t in texts]), runs.WORDS)
        text = np.repeat(np.arange(len(n)), n)
        flat = [w for t in texts for w in t]
        return [(tuple(flat[f + k : f + k + 13]), s) for f, m, s in zip(*map(np.ndarray.tolist, automata.pieces(automata.word_hashes(found), text)), strict=True) for k in range(m + 1)]

    whole = windows([words])
    assert [w for w, _ in whole] == [tuple(words[i : i + 13]) for i in range(288)]
    parts = windows([["x"], words[100:140], [], words[100:140], words[:12]])
    assert [w for w, _ in parts] == [tuple(words[i : i + 13]) for i in range(100, 128)] * 2 and set(parts) <= set(whole)
    monkeypatch.setattr(automata, "PLACES", 50)
    assert sorted(windows([words])) == sorted(whole)


def planted(rng):
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, phrase = fresh(60), fresh(5)
    rows = [(k, " ".join(fresh(30) + passage[k % 7 : 20 + k % 41] + fresh(3) + phrase + fresh(20))) for k in range(40)]
    rows += [(100 + k, rows[k][1]) for k in range(10)] + [(3, rows[8][1]), (None, rows[5][1]), (200, "a b " * 40), (201, "a b " * 30 + "\n c"), (202, " ".join(passage[:12])), (203, "  " + "\t".join(passage[:13]) + "\n")]
    return rows


@pytest.mark.parametrize("how", [{}, {"shard": 9, "many": 2, "share": 5, "most_bits": 1024}])
def test_substring_dedup_matches_brute_force(spark, odd_docs, how):
    rows = planted(random.Random(11)) + [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS d", "2 AS t", "3 AS spans", "4 AS sig", "5 AS words", "6 AS _text")
    got = sorted((tuple(r) for r in automata.digests(df.repartition(6), **how).collect()), key=str)
    assert got == brute_windows(rows)


def test_documents_that_lose_words_are_found_by_broadcast_or_shuffle(spark, monkeypatch):
    rows = planted(random.Random(13))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    assert sorted((tuple(r) for r in automata.digests(df).collect()), key=str) == brute_windows(rows)


def test_substring_dedup_keeps_rows_and_columns(spark, odd_docs, no_docs):
    rows = planted(random.Random(12))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _d", "2 AS _spans")
    kept = automata.dedup(df)
    assert kept.columns == df.columns
    texts = {r["doc_id"]: r["text"] for r in kept.where("doc_id IS NOT NULL").collect()}
    want = {r[0]: r for r in brute_windows(rows)}
    assert all(hashlib.sha256(b" ".join(texts[k].encode().split())).hexdigest() == want[k][3] for k in texts if k not in (3,))
    assert texts[202] == dict(rows)[202] and texts[203] == "  "
    assert automata.dedup(odd_docs).count() == odd_docs.count()
    assert automata.digests(no_docs).collect() == [] and automata.dedup(no_docs).collect() == []
