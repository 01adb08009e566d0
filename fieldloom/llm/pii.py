"""Personal data by candidate gradient boosting, with built-in Spark expressions and MLlib only.

Base spans come from four patterns and checks of the digits (octets, Luhn, number of digits). Generators of high recall propose further, overlapping
spans in looser forms. What fails the check of its kind is refuted and never added; boosted trees judge the rest by format and context. They are trained here, on candidates of the
corpus itself. Base spans are positive, and so are the looser forms written from them (a phone number without its plus, a card in dots, [at] and [dot]), in
the context of the original. Negative are matches and candidates that fail their check, in their own context. No feature tells what a check tells (Luhn, octets, numbers of digits, dates, endings of
addresses), so the trees can't repeat the checks: they learn in what forms and beside what words candidates turn out right, and a candidate that passes its check by chance, such as an order number, looks like the many
beside it that don't. Candidates that no check refutes have no label: they teach nothing and are what the trees are asked about. MLlib fits the trees to
all that have one and they are compiled into a column expression. A threshold for each kind is calibrated on all of them, each scored by trees fitted without it, at a
precision asked for. Candidates over the threshold that touch no base span and no span added before them are added; base spans always stay.

Edge cases: a null text is empty and has no spans; positions are code points, ends exclusive; repeated rows are judged one by one; texts of any length
are searched whole, in time that is in proportion to their length (but for chains of overlapping candidates, which take the square of a chain's); without candidates of both classes and of several texts or contexts nothing is added; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from fieldloom.llm.rules import bind
from fieldloom.llm.shared import materialize, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Possessive where nothing that follows could match what is given back, and not begun inside a run whose start has failed: time stays in proportion to the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser forms of the same kinds.
GENERATORS = {
    "email": r"(?:\G|(?<![^\s,;<>]))[^\s,;<>@()\[\]]{1,64}+\s?(?:@|[(\[]\s?at\s?[)\]])\s?[^\s,;<>@()\[\]]{1,64}(?:\s?[(\[]\s?dot\s?[)\]]\s?[A-Za-z]{2,24})?",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<![0-9.])[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.–/-]{0,2}[0-9]){11,22}(?![0-9])",
    "phone": r"(?<![0-9+(])[+(]?[0-9][0-9\x20().–/-]{5,20}[0-9](?![0-9])",
}
#: A text without this has no match of the kind.
NEEDED = {"email": "@|[(\\[]\\s?at\\s?[)\\]]", "ip": "[0-9A-Fa-f][.:]", "card": "[0-9][0-9\\x20.–/-]", "phone": "[0-9]"}
#: Words before a span that speak for its kind, in order of KINDS, and those that speak for a number of another sort.
KEYWORDS = (
    r"(?i)(?:mail|contact|kontakt|write|address)",
    r"(?i)(?:\bips?\b|host|server|addr|ping|router)",
    r"(?i)(?:card|karte|carte|tarjeta|visa|mastercard|kredit|credit|pay)",
    r"(?i)(?:tel|phone|fon|call|fax|mobil|\bcell|ruf|llam|appel)",
)
OTHERS = r"(?i)(?:order|bestell|invoice|rechnung|factur|ref\b|\bid\b|\bnr\b|\bno\b|num|version|\bv\b|release|isbn|serial|ticket|account|konto|item|code|price|total)"
BEFORE, AFTER, BLOCK = 24, 4, 64
#: Parts of the candidates that are left out in turn for the thresholds, and the candidates that a leaf has at least.
FOLDS, LEAF = 4, 5
FEATURES = ("kind", "n_runs", "longest_run", "n_marks", "n_letters", "brackets", "plus", "left_word", "right_word", "keyword", "other_kind", "other_sort")


def before(a: Column, zero: Column, join: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """What join makes of all entries before each entry of a, which must not be empty. Blocks of blocks keep the work in proportion to the entries."""
    fold = lambda xs: F.aggregate(xs, zero, join)
    if not levels:
        return F.transform(a, lambda _, i: fold(F.slice(a, F.lit(1), i)))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int")), lambda b: F.slice(a, b * BLOCK + 1, F.lit(BLOCK)))

    def within(parts: Column) -> Column:
        sums = bind(F.transform(parts, fold), lambda x: before(x, zero, join, levels - 1))
        return bind(sums, lambda s: F.flatten(F.transform(parts, lambda p, b: F.transform(p, lambda _, i: join(F.get(s, b), fold(F.slice(p, F.lit(1), i)))))))

    return bind(blocks, within)


MATCHES = "array<struct<s:bigint,e:bigint,m:string,left:string,right:string>>"


def sums(x: Column) -> Column:
    """Sums of what stands before each entry."""
    return before(x, F.lit(0).cast("long"), lambda a, b: a + b)


def latest(x: Column) -> Column:
    """The largest of what stands before each entry, 0 for the first."""
    return before(x, F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))


def matches(text: Column, pattern: str, needed: str) -> Column:
    """All matches of a pattern as (s, e, m, left, right), by code points; left and right are what stands beside a match, up to the next one."""

    def placed(p: Column) -> Column:
        size = lambda x: F.char_length(x).cast("long")
        lengths = F.flatten(F.transform(p["hits"], lambda m, k: F.array(size(F.get(p["gaps"], k)), size(m))))
        at = lambda s: F.transform(p["hits"], lambda m, k: F.struct(F.get(s, 2 * k + 1).alias("s"), (F.get(s, 2 * k + 1) + F.char_length(m)).alias("e"), m.alias("m"), F.right(F.get(p["gaps"], k), F.lit(BEFORE)).alias("left"), F.left(F.get(p["gaps"], k + 1), F.lit(AFTER)).alias("right")))
        return F.when(F.size(p["hits"]) == 0, F.array().cast(MATCHES)).otherwise(bind(bind(lengths, sums), at))

    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(F.regexp_like(text, F.lit(needed)), bind(parts, placed)).otherwise(F.array().cast(MATCHES))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    d = F.split(F.reverse(digits(m)), "")

    def value(x: Column, k: Column) -> Column:
        n = F.coalesce(x.try_cast("int"), F.lit(0)) * F.when(k % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    return F.aggregate(F.transform(d, value), F.lit(0), lambda a, x: a + x) % 10 == 0


OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"


def holds(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern passes the check of its kind."""
    n = F.char_length(digits(m))
    return {"email": F.lit(True), "ip": F.regexp_like(m, F.lit(OCTETS)), "card": n.between(16, 19) & luhn(m), "phone": n.between(8, 15)}[kind]


def plain(m: Column) -> Column:
    """An address with its [at] and [dot] written as signs."""
    return F.regexp_replace(F.regexp_replace(m, r"\s?[(\[]\s?at\s?[)\]]\s?", "@"), r"\s?[(\[]\s?dot\s?[)\]]\s?", ".")


MAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$"
#: Eight groups, or fewer with one gap.
GROUPS = r"^(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?!.*::.*::)(?=.*::)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4})$"
DATE = r"^\D?(?:(?:19|20)[0-9]{2}[-/.\x20](?:0?[1-9]|1[0-2])[-/.\x20](?:0?[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])[-/.\x20](?:0?[1-9]|[12][0-9]|3[01])[-/.\x20](?:19|20)[0-9]{2})(?!\d)"


def refuted(kind: str, c: Column) -> Column:
    """Whether a generator's candidate fails what every form of its kind must hold."""
    m, n = c["m"], F.char_length(digits(c["m"]))
    return {
        "email": ~F.regexp_like(plain(m), F.lit(MAIL)),
        "ip": ~F.regexp_like(m, F.lit(OCTETS)) & ~F.regexp_like(m, F.lit(GROUPS)),
        "card": ~(n.between(16, 19) & luhn(m)),
        "phone": ~n.between(8, 15) | F.regexp_like(m, F.lit(DATE)),
    }[kind]


CANDIDATE = "array<struct<k:int,s:bigint,e:bigint,m:string,left:string,right:string,label:double>>"


def candidates(text: Column) -> Column:
    """(k, s, e, m, left, right, label): all matches of the base patterns, label 1 if their check holds (these are the base spans), else 0; and all
    of the generators, label 0 if refuted, else null."""

    def of(k: int, kind: str, pattern: str, label: Callable[[Column], Column]) -> Column:
        return F.transform(matches(text, pattern, NEEDED[kind]), lambda x: F.struct(F.lit(k).alias("k"), *[x[f].alias(f) for f in ("s", "e", "m", "left", "right")], label(x).alias("label")))

    base = [of(k, kind, BASE[kind], lambda x, kind=kind: holds(kind, x["m"]).cast("double")) for k, kind in enumerate(KINDS)]
    loose = [of(k, kind, GENERATORS[kind], lambda x, kind=kind: F.when(refuted(kind, x), F.lit(0.0))) for k, kind in enumerate(KINDS)]
    return F.concat(*base, *loose).cast(CANDIDATE)


def base_of(cands: str | Column) -> Column:
    """(k, s, e) of the base, by kind, then start."""
    return F.transform(F.filter(cands, lambda c: c["label"] == 1), lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def loosened(k: Column, m: Column) -> Column:
    """Looser forms of a base span, itself included: [at] and [dot], a card in dots, a phone number without its plus, and without the code of its country."""
    mail = F.regexp_replace(F.regexp_replace(m, "@", " [at] "), r"\.([A-Za-z0-9-]+)$", " [dot] $1")
    card = F.regexp_replace(digits(m), r"([0-9]{4})(?=[0-9])", "$1.")
    local = F.regexp_replace(m, r"^\+[0-9]{1,3}[\x20.-]*(?=[(0-9])", "")
    phone = F.array(m, F.regexp_replace(m, r"^\+", ""), F.when(F.char_length(digits(local)) >= 8, local).otherwise(m))
    return F.when(k == 0, F.array(m, mail)).when(k == 2, F.array(m, card)).when(k == 3, phone).otherwise(F.array(m))


def features(c: Column) -> dict[str, Column]:
    """Format and context of a candidate, without anything that a check of its kind goes by: runs are counted, but only up to three digits of the longest, as octets and numbers of digits depend on more."""
    m, left = c["m"], c["left"]
    count = lambda pattern: F.regexp_count(m, F.lit(pattern)).cast("double")
    speaks = [F.regexp_like(left, F.lit(k)) for k in KEYWORDS]
    own = F.element_at(F.array(*speaks), c["k"] + 1)
    return {
        "kind": c["k"].cast("double"),
        "n_runs": F.least(count("[0-9]+"), F.lit(6.0)),
        "longest_run": F.when(F.regexp_like(m, F.lit("[0-9]{3}")), 3.0).when(F.regexp_like(m, F.lit("[0-9]{2}")), 2.0).otherwise(F.least(count("[0-9]"), F.lit(1.0))),
        "n_marks": F.least(count(r"[^0-9A-Za-z+]"), F.lit(4.0)),
        "n_letters": F.least(F.char_length(F.regexp_replace(plain(m), "[^A-Za-z]", "")), F.lit(24)).cast("double"),
        "brackets": count(r"[()\[\]]"),
        "plus": m.startswith("+").cast("double"),
        "left_word": F.regexp_like(left, F.lit(r"[\p{L}0-9]$")).cast("double"),
        "right_word": F.regexp_like(c["right"], F.lit(r"^[\p{L}0-9]")).cast("double"),
        "keyword": own.cast("double"),
        "other_kind": (F.exists(F.array(*speaks), lambda x: x) & ~own).cast("double"),
        "other_sort": F.regexp_like(left, F.lit(OTHERS)).cast("double"),
    }


@dataclass(frozen=True)
class Judge:
    """Trees as (weight, nested splits) and a threshold for each kind; none if nothing could be learnt."""

    trees: tuple = ()
    thresholds: tuple[float, ...] = (2.0,) * len(KINDS)

    def score(self, f: dict[str, Column]) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, at, low, high = node
            return F.when(f[FEATURES[feature]] <= at, walk(low)).otherwise(walk(high))

        total = F.lit(0.0)
        for weight, root in self.trees:
            total = total + F.lit(weight) * walk(root)
        return 1 / (1 + F.exp(-2 * total))


def read_tree(node):
    """A fitted tree as nested (feature, threshold, low, high), leaves as numbers."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), read_tree(node.leftChild()), read_tree(node.rightChild()))


def fit(found: DataFrame, precision: float = 0.995, rounds: int = 12, seed: int = 42) -> Judge:
    """Fit trees to all labelled candidates and calibrate thresholds on all of them, each scored by trees that were fitted without its fold.

    Candidates alike in features, label and fold are one row with their number as its weight: MLlib's sums are those over the candidates one by one. Those
    of equal text and context share a fold. A threshold lies halfway between the smallest score at which `precision` of the kind's candidates at or above
    it are positive and the next score below, at 0.5 or more.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    # digits too few or too many for a card are no example of what a card isn't: only numbers that fail for their check digit are
    length = F.char_length(digits(F.col("c.m")))
    one = found.select(F.explode(F.filter("cands", lambda c: c["label"].isNotNull())).alias("c")).where((F.col("c.k") != KINDS.index("card")) | length.between(16, 19))
    one = one.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), "c.m", "c.left", "c.right"), F.lit(FOLDS)).cast("int"))
    # base patterns' matches, right or wrong, also in a looser form
    forms = F.when(F.col("c.label") == 1, loosened(F.col("c.k"), F.col("c.m"))).otherwise(F.array(F.col("c.m"), F.regexp_replace("c.m", r"^\+", "")))
    rows = one.select("fold", "c.label", F.explode(F.array_distinct(forms)).alias("m"), F.col("c.k").alias("k"), F.col("c.left").alias("left"), F.col("c.right").alias("right")).select("fold", "label", F.struct("m", "k", "left", "right").alias("c"))
    rows = rows.select("fold", "label", *[x.alias(name) for name, x in features(F.col("c")).items()])
    rows = materialize(rows.groupBy("fold", "label", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("n")), "candidates")
    sizes = rows.groupBy("fold", "label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # 2 x FOLDS at most
    folds = sorted({r["fold"] for r in sizes})
    if len({r["label"] for r in sizes}) < 2 or len(folds) < 2:
        return Judge()
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    # MLlib looks for splits in a sample of max(bins^2, 10,000) rows: with so many bins it reads all of them
    bins = max(32, ceil(sqrt(sum(r["rows"] for r in sizes))))

    def trees(left_out: int | None) -> tuple:
        used = [f for f in folds if f != left_out]
        least = min((LEAF - 0.5) / sum(r["n"] for r in sizes if r["fold"] in used), 0.499)  # weights are whole numbers
        gbt = GBTClassifier(weightCol="n", maxIter=rounds, maxDepth=4, stepSize=0.3, seed=seed, minWeightFractionPerNode=least, maxBins=bins)
        model = gbt.fit(vectors.where(F.col("fold").isin(used)))
        return tuple((float(w), read_tree(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t.rootNode())) for w, t in zip(model.treeWeights, model.trees, strict=True))

    with ThreadPoolExecutor(2) as pool:  # many short jobs each: two side by side, as MLlib's own validators run them
        *parts, whole = pool.map(inheritable_thread_target(found.sparkSession)(trees), [*folds, None])
    columns = {name: F.col(name) for name in FEATURES}
    score = F.coalesce(*[F.when(F.col("fold") == k, Judge(part).score(columns)) for k, part in zip(folds, parts, strict=True)])
    scores = rows.groupBy("kind", F.round(score, 3).alias("s")).agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()  # 4 x 1001 at most
    thresholds = []
    for k in range(len(KINDS)):
        best, good, all_ = 2.0, 0.0, 0
        own = sorted((r for r in scores if r["kind"] == k), key=lambda r: -r["s"])
        for r, below in zip(own, [*(x["s"] for x in own[1:]), 0.0], strict=False):
            good, all_ = good + r["good"], all_ + r["n"]
            if good >= precision * all_:
                best = max((r["s"] + below) / 2, 0.5)
        thresholds.append(best)
    return Judge(whole, tuple(thresholds))


SPANS = "array<struct<s:bigint,e:bigint,k:int>>"


def with_added(found: DataFrame, judge: Judge) -> DataFrame:
    """found with `added`: candidates over their threshold that touch no base span and no span added before them, by start."""
    none = F.array().cast(SPANS)
    if not judge.trees:
        return found.withColumn("added", none)
    limits = F.array(*map(F.lit, judge.thresholds))
    zero, far = F.lit(0).cast("long"), F.lit(2**62)

    def wanted(c: Column) -> Column:
        return bind(F.struct(*[x.alias(name) for name, x in features(c).items()]), lambda f: judge.score({name: f[name] for name in FEATURES})) >= F.element_at(limits, c["k"] + 1)

    some = lambda of, name: F.when(F.size(name) == 0, F.array().cast("array<bigint>")).otherwise(of)
    # at: where a candidate stands among all; only those that touch no base span are judged
    asked = F.filter(F.transform("cands", lambda c, i: F.struct(c["s"].alias("s"), c["e"].alias("e"), c["k"].alias("k"), i.alias("at"), c["label"].alias("label"))), lambda c: c["label"].isNull())
    base = F.transform(F.filter("cands", lambda c: c["label"] == 1), lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"), F.lit(-1).alias("k"), F.lit(-1).alias("at")))

    def greedy(chain: Column) -> Column:
        """Of overlapping spans by start, those that begin when the last one taken has ended."""
        start = F.struct(F.lit(-1).cast("long").alias("end"), none.alias("got"))
        return F.aggregate(chain, start, lambda a, y: F.when(y["s"] >= a["end"], F.struct(y["e"].alias("end"), F.array_append(a["got"], y).alias("got"))).otherwise(a))["got"]

    steps = {
        "_asked": F.transform(asked, lambda c: c.dropFields("label")),
        "_all": F.when(F.size("_asked") == 0, F.array().cast("array<struct<s:bigint,e:bigint,k:int,at:int>>")).otherwise(F.array_sort(F.concat("_asked", base))),
        # of the base (k = -1): the latest end before each span, and the first start after it
        "_ends": F.transform("_all", lambda y: F.when(y["k"] < 0, y["e"]).otherwise(zero)),
        "_starts": F.reverse(F.transform("_all", lambda y: F.when(y["k"] < 0, y["s"]).otherwise(far))),
        "_before": some(latest(F.col("_ends")), "_all"),
        "_after": F.reverse(some(before(F.col("_starts"), far, lambda a, b: F.least(a, b)), "_all")),
        "_clear": F.filter("_all", lambda y, i: (y["k"] >= 0) & (F.get("_before", i) <= y["s"]) & (F.get("_after", i) >= y["e"])),
        "_good": F.transform(F.filter("_clear", lambda y: wanted(F.get("cands", y["at"]))), lambda y: y.dropFields("at")),
        "_own": F.transform("_good", lambda y: y["e"]),
        "_last": some(latest(F.col("_own")), "_own"),
        # chains of overlapping spans begin where all before have ended
        "_heads": F.filter(F.transform("_good", lambda y, i: F.when(F.get("_last", i) <= y["s"], i)), lambda i: i.isNotNull()),
        "_chains": F.transform("_heads", lambda b, j: F.slice("_good", b + 1, F.coalesce(F.get("_heads", j + 1), F.size("_good")) - b)),
        "added": F.flatten(F.transform("_chains", lambda c: F.when(F.size(c) == 1, c).otherwise(greedy(c)))),
    }
    out = found
    for name, step in steps.items():
        out = out.withColumn(name, step)
    return out.drop(*[x for x in steps if x != "added"])


def spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, Judge]:
    """doc_id, base (k, s, e) and added (s, e, k) of every row, and the judge that was learnt."""
    found = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text_or_empty(text)).alias("cands")), "spans")
    judge = fit(found)
    return with_added(found, judge).select("doc_id", base_of("cands").alias("base"), "added"), judge


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind, then start."""
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def report(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts and digest of the base spans of every row, and all its spans."""
    out, _ = spans(docs, text)
    every = F.concat(F.transform("base", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))), F.transform("added", lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, text: str = "text", mask: str = "[{}]") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one. Other columns pass through."""
    columns = docs.columns
    inner = docs.select(*[F.col(c).alias(f"c_{k}") for k, c in enumerate(columns)])
    own = f"c_{columns.index(text)}"
    found = materialize(inner.select(*inner.columns, candidates(text_or_empty(own)).alias("cands")), "spans")
    found = with_added(found, fit(found))
    every = F.array_sort(F.concat(F.transform(base_of("cands"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))), "added"))
    labels = F.array(*[F.lit(mask.format(k)) for k in KINDS])
    part = lambda chars, a, n: F.array_join(F.slice(chars, (a + 1).cast("int"), F.greatest(n, F.lit(0)).cast("int")), "")

    def clean(p: Column) -> Column:
        spans_, chars, ends = p["spans"], p["chars"], p["ends"]
        pieces = F.transform(spans_, lambda x, i: F.when(x["s"] >= F.get(ends, i), F.concat(part(chars, F.get(ends, i), x["s"] - F.get(ends, i)), F.element_at(labels, x["k"] + 1))).otherwise(""))
        last = F.array_max(F.transform(spans_, lambda x: x["e"]))
        return F.concat(F.array_join(pieces, ""), part(chars, last, F.size(chars) - last))

    found = found.withColumn("_spans", every).withColumn("_e", F.transform("_spans", lambda x: x["e"])).withColumn("_ends", F.when(F.size("_e") > 0, latest(F.col("_e"))))
    new = F.when(F.size("_spans") == 0, F.col(own)).otherwise(bind(F.struct(F.col("_spans").alias("spans"), F.split(own, "").alias("chars"), F.col("_ends").alias("ends")), clean))
    return found.select(*[(new if f"c_{k}" == own else F.col(f"c_{k}")).alias(c) for k, c in enumerate(columns)])
