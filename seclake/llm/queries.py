"""The thin queries opN_: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, embedding_dedup, exact_dedup, language_id, line_dedup, merkle_manifest, packing, ranked_search, simhash_dedup, substring_dedup, token_counts, toxicity, url_filters
from ..plans.workspace import shared_folder
from .common import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_packing")
def op1_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents"))


@query("op7_exact_dedup", """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)""")
def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


@query("op9_line_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN c ON k.key = c.key GROUP BY doc_id""")
def op9_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.kept_lines(table(spark, sf, "documents"), by_id=True)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return decontamination.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


URL_RULES = [
    url_filters.UrlRule("allow", "com", "/"),
    url_filters.UrlRule("block", "example.com", "/en/"),
    url_filters.UrlRule("allow", "www.example.com", "/en/"),
    url_filters.UrlRule("block", "net", "/es/"),
    url_filters.UrlRule("block", "net", "/fr/"),
]


@query("op3_url_filters")
def op3_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf, "pages"), URL_RULES).drop("shape")


@query("op8_simhash_dedup")
def op8_simhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf, "documents"))


@query("op4_substring_dedup")
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substring_dedup.without_repeats(table(spark, sf, "documents"), with_text=False)


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held = held_out(F.col("doc_id"), 4, 2)
    model = language_id.fit(docs.where(~held))
    return language_id.identify(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, held = table(spark, sf, "documents"), held_out(F.col("doc_id"), 5, 0)
    model = toxicity.fit(docs, table(spark, sf, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all documents; then those labelled toxic are deleted, and those of low quality are revised to hold an end token.

    The last batch is sent twice, of which the second has no effect.
    """
    store = token_counts.CountStore(spark, shared_folder(spark))
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    store.commit(1, token_counts.changes(token_counts.token_counts(docs, {"bpe": "word_bpe_49k.json", "words": "words"}), "insert"))
    known = store.ledger().join(labels.select(F.col("doc_id").cast("string").alias("doc_id"), "quality", "toxic"), "doc_id")
    store.commit(2, token_counts.changes(known.where("toxic = 1"), "delete"))
    low = known.where("quality = 0 AND toxic = 0 AND version = 'bpe'").withColumn("n_tokens", F.col("n_tokens") + 1)
    for _ in range(2):
        store.commit(3, token_counts.changes(low, "revise"))
    store.compact()
    return store.totals()


@query("op11_embedding_dedup", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN least ON least.a = vec_id""")
def op11_embedding_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf, "embeddings"))


@query("op12_ranked_search", r"""
WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS repeats FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
whole AS (SELECT count(*) AS documents, sum(n)::BIGINT AS total FROM lengths),
postings AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
held AS (SELECT term, floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, whole GROUP BY term),
scores AS (
  SELECT item_id, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * documents) // total))))::BIGINT AS score
  FROM asked JOIN held USING (term) JOIN postings USING (term) JOIN lengths USING (doc_id), whole GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scores WHERE score > 0) WHERE rank <= 10""")
def op12_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return ranked_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op13_merkle_manifest", """
WITH RECURSIVE docs AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: xor(d >> 1, 3988292384 * (d & 1))))) % 7 = 0 AS bad,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
leaves AS (
  SELECT doc_id, leaf, changed, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n
  FROM (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN bad THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS changed FROM docs)),
up AS (
  SELECT tree, 0 AS lvl, idx, n, leaf AS h FROM leaves
  UNION ALL SELECT tree, lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 2, n),
subroots AS (SELECT tree, lvl AS height, h, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, idx, n, h FROM subroots
  UNION ALL SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 2, n),
root AS (SELECT lvl AS height, h FROM top WHERE n = 1),
low AS (
  SELECT tree, idx, 0 AS lvl, coalesce(changed, leaf) AS d, '' AS proof FROM leaves
  UNION ALL SELECT f.tree, f.idx, f.lvl + 1, sha256(CASE WHEN (f.idx >> f.lvl) & 1 = 1 THEN s.h || f.d ELSE f.d || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM low f JOIN subroots t ON t.tree = f.tree AND f.lvl < t.height LEFT JOIN up s ON s.tree = f.tree AND s.lvl = f.lvl AND s.idx = xor(f.idx >> f.lvl, 1)),
high AS (
  SELECT f.tree, f.idx, t.idx AS at, 0 AS lvl, f.d, f.proof FROM low f JOIN subroots t ON t.tree = f.tree AND f.lvl = t.height
  UNION ALL SELECT f.tree, f.idx, f.at, f.lvl + 1, sha256(CASE WHEN (f.at >> f.lvl) & 1 = 1 THEN s.h || f.d ELSE f.d || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM high f JOIN root r ON f.lvl < r.height LEFT JOIN top s ON s.lvl = f.lvl AND s.idx = xor(f.at >> f.lvl, 1))
SELECT l.doc_id, l.leaf, t.h AS subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.d AS folded_root, f.d = r.h AS verified
FROM leaves l JOIN subroots t ON t.tree = l.tree JOIN root r ON true JOIN high f ON f.tree = l.tree AND f.idx = l.idx AND f.lvl = r.height""")
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of all documents, a tree for each language; proofs of tampered rows must not verify."""
    bad = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle_manifest.manifest(table(spark, sf, "documents"), tampered={"n_chars": F.col("n_chars") + 1}, tampered_where=bad)
