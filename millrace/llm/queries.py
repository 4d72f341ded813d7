"""The registered query of every operator: its production parameters, the whole table, the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import computed_once
from millrace.llm import (collocations, fst_pieces, grouped_packing, katz, noisy_toxicity, periodic_runs, prob_minhash, rank_order, rp_forest, secret_markov,
                          suffix_dedup, url_rules, wu_manber)
from millrace.llm.common import fold, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = wu_manber.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return wu_manber.leak_digest(leaks)


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES["op5_wu_manber"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT item_id, least(10, len(w)) AS m, unnest(list_transform(generate_series(1, greatest(1, len(w) - 9)),
         lambda k: array_to_string(w[k:k + 9], ' '))) AS win FROM i WHERE len(w) > 0),
pat AS (SELECT DISTINCT item_id, m, win FROM iw),
ms AS (SELECT DISTINCT m FROM pat),
dw AS (SELECT doc_id, ms.m, unnest(generate_series(1, len(w) - ms.m + 1)) AS k, w FROM d, ms WHERE len(w) >= ms.m),
dv AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS win FROM dw),
hit AS (SELECT doc_id, dv.m, k, item_id FROM dv JOIN pat ON dv.m = pat.m AND dv.win = pat.win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + m - 1)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)"""


@_query
def op6_secret_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return secret_markov.secret_digest(secret_markov.find_secrets(docs, secret_markov.train(docs)))


@_query
def op7_fst_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, number of pieces, the pieces, whether they decode to the normalised text, digest of the decoded text."""
    encoded = fst_pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"))
    return encoded.select("doc_id", F.size("_pieces.ids").cast("long").alias("n_pieces"), F.col("_pieces.ids").alias("piece_ids"),
                          F.col("_pieces.round_trip").alias("round_trip"), F.col("_pieces.decoded_sha256").alias("decoded_sha256"))


@_query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages", "page_id", "url")).drop("n_rules_run")


ORACLES["op10_url_rules"] = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
h AS (SELECT page_id, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'),
                              ('com', '/de/', 'block')),
best AS (SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
         FROM (SELECT DISTINCT host, path FROM h) JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY 1, 2)
SELECT page_id, h.host, h.path, rule, coalesce(v, CASE WHEN regexp_matches(h.host || h.path,
         '(?i)(^|[^a-z0-9])(adserver|casino|doubleclick|porn|xxx)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN best ON h.host = best.host AND h.path = best.path"""


@_query
def op9_noisy_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = noisy_toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    value = F.col("_toxicity.score")
    return noisy_toxicity.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), value.alias("score"),
                                                    F.when(value >= noisy_toxicity.CUTOFF, 1).otherwise(0).alias("predicted"))


@_query
def op2_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


@_query
def op3_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    found = rank_order.identify(docs.drop("lang"), rank_order.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), F.col("_lang.lang").alias("lang_pred"), F.col("_lang.score").alias("score"))


@_query
def op8_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


@_query
def op4_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents", "doc_id", "text"), fold(F.col("doc_id"), 5) == 1)


@_query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")).drop("removed")


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    text = periodic_runs.repeated_from(F.col("doc_id"), F.col("text"))
    return periodic_runs.run_digest(periodic_runs.find_runs(computed_once(docs, text=text)))


@_query
def op12_grouped_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = grouped_packing.cut_documents(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return grouped_packing.pack(pieces)


@_query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(collocations.frequent_phrases(table(spark, sf_dir, "documents", "lang", "text")))


ORACLES["op13_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(w) - k + 1), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (VALUES (1), (2), (3)) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS s FROM f WHERE k >= 2 AND a >= 10),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(s[1:j], ' ') AS lp, array_to_string(s[j + 1:], ' ') AS rp FROM c, (VALUES (1), (2)) t(j) WHERE j < k),
sc AS (SELECT cut.*, x.a AS l, y.a AS r, CAST(CAST(1000000 AS HUGEINT) * cut.a * cut.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
       FROM cut JOIN f x ON cut.lang = x.lang AND lp = x.phrase JOIN f y ON cut.lang = y.lang AND rp = y.phrase),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS i FROM sc),
long AS (SELECT lang, part, max(a) AS b FROM (SELECT lang, a, lp AS part FROM cut WHERE k = 3 AND j = 2 UNION ALL SELECT lang, a, rp FROM cut WHERE k = 3 AND j = 1) GROUP BY ALL),
kept AS (SELECT best.* FROM best LEFT JOIN long ON best.lang = long.lang AND phrase = part WHERE i = 1 AND (b IS NULL OR 100 * b < 50 * a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
