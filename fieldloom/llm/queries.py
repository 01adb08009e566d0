"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import automata, bpe, divergence, embed, lines, mixing, pii, quality, rules, simhash, suffix, tokens, whitening
from fieldloom.llm.shared import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all ids as directly addressable codes and read every document's back."""
    files = tokens.write(documents(spark, sf_dir), tokenizer_path(), tokens.new_path(spark), end_id=2)
    return tokens.digests(files)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of both."""
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.report(documents(spark, sf_dir).select("doc_id", "text"))


def op5_embedding_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return embed.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to earlier copies of its line runs."""
    return lines.digests(documents(spark, sf_dir))


def op7_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.per_document(documents(spark, sf_dir).select("doc_id", "source", "text"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to repeated strings of 200 bytes."""
    return suffix.digests(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return rules.judge(documents(spark, sf_dir).select("doc_id", "text")).withColumn("failed", F.array_join("failed", ","))


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that aren't held out."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model, feats = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(feats, model)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight leading whitened components of every vector."""
    return whitening.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's terms differ from the other sources' and from its language's."""
    return divergence.audit(documents(spark, sf_dir).select("text", "lang", "source"))


def op13_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to word runs of documents before it."""
    return automata.digests(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_codes": op1_token_codes,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_simhash": op3_simhash,
    "op4_pii": op4_pii,
    "op5_embedding_index": op5_embedding_index,
    "op6_line_dedup": op6_line_dedup,
    "op7_weighted_mix": op7_weighted_mix,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_qda": op10_quality_qda,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_source_divergence": op12_source_divergence,
    "op13_automaton_dedup": op13_automaton_dedup,
}


def rules_sql() -> str:
    """op9 in DuckDB's SQL, from the same table of thresholds."""

    def names(table: tuple) -> str:
        fails = lambda r: " OR ".join([f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None))
        return ", ".join(f"CASE WHEN {fails(r)} THEN '{r.name}' END" for r in table)

    word, stop = r"[^\x20\x09-\x0D]", ", ".join(f"'{w}'" for w in rules.STOP_WORDS)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2]))) AS g FROM d WHERE len(w) > 2),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT doc_id, least(3, i - lag(i, 1, i - 3) OVER (PARTITION BY doc_id ORDER BY i)) AS n FROM again) GROUP BY 1),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS BIGINT) AS n_stop_words, CAST(len(l) AS BIGINT) AS n_lines FROM d LEFT JOIN rep USING (doc_id)),
r AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0.0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0.0) AS symbol_ratio, coalesce(n_stop_words / nullif(n_words, 0), 0.0) AS stop_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0.0) AS dup_line_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0.0) AS repeat_ratio FROM m),
f AS (SELECT *, concat_ws(',', {names(rules.BASE)}) AS b, concat_ws(',', {names(rules.BASE + rules.RULES)}) AS failed FROM r)
SELECT * EXCLUDE (b), b <> '' AS base_failed, failed = '' AS kept FROM f"""


def divergence_sql() -> str:
    """op12 in DuckDB's SQL."""
    share = "1 + (1000000000::HUGEINT * (n + 2)) // total"
    return rf"""WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT k, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT k) >= 10), size AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN kept USING (lang, term) GROUP BY ALL),
every AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT lang, source, term, n, {share} AS p FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source) + 2 * v AS total FROM every JOIN size USING (lang))),
q AS (SELECT lang, term, {share} AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang) + 2 * v AS total FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) JOIN size USING (lang))),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms QUALIFY rank <= 10)"""


def windows_sql() -> str:
    """op13 in DuckDB's SQL."""
    word = r"[^\x20\x09-\x0D]+"
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
f AS (SELECT g, min(doc_id) AS first FROM g GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM g JOIN f USING (g) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS x, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(x, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


#: The other operators rest on a tokenizer, XXH64, trees or iteration, which this SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {"op9_quality_rules": rules_sql(), "op12_source_divergence": divergence_sql(), "op13_automaton_dedup": windows_sql()}
