"""Corpus curation: packing into windows, mixing by budget, copies by quality, interleaving, recent turns,
repeated lines, filters with reasons, clusters of prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import tokens as K
from millrace.operators import clusters as G, context as C, filters as H, lines as L, mixing as M, packing as P, selection as S
from millrace.plans.corpus import s_trim
from millrace.plans.frames import table
from millrace.plans.indexing import s_hash
from millrace.plans.registry import query
from millrace.session import written

WINDOW = 2048
WEIGHTS = {f"src{i}": 1 + i for i in range(20)}


def sized(spark, sf):
    """Documents with their tokens and an end token. The numbers are written once, as the jobs over them read them several times and texts should be
    read once."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    return written(docs.select("doc_id", "source", "lang", (F.size(K.tokens(F.coalesce("text", F.lit("")))) + 1).cast("bigint").alias("n_tokens")), "sized")


SIZED = r"""sized AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(coalesce(text, ''), '<\|eos\|>|[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]')) + 1 AS BIGINT) AS n_tokens
  FROM documents)"""


@query("pack_documents")
def pack_documents(spark, sf):
    return P.pack_documents(sized(spark, sf).select("doc_id", "n_tokens"), "doc_id", "n_tokens", WINDOW)


@query("packing_report", f"""
WITH {SIZED} SELECT count(*) AS documents, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE n_tokens > {WINDOW}) AS oversized, 0 AS misplaced, 0 AS overfull,
  true AS well_filled FROM sized""")
def packing_report(spark, sf):
    return P.packing_report(pack_documents(spark, sf), "n_tokens", WINDOW)


# Water-filling and the cut, on the check side.
BUDGETS = f"""{SIZED}, w AS (SELECT concat('src', CAST(i AS VARCHAR)) AS source, i + 1 AS weight FROM range(20) t(i)),
total AS (SELECT CAST(sum(n_tokens) * 6 // 10 AS BIGINT) AS total FROM sized),
av AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS available FROM sized GROUP BY source),
aw AS (SELECT av.source, available, coalesce(weight, 0) AS weight FROM av LEFT JOIN w ON av.source = w.source),
r AS (SELECT *, (SELECT total FROM total) - coalesce(sum(available) OVER (ORDER BY available / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
  sum(weight) OVER (ORDER BY available / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM aw WHERE weight > 0),
s AS (SELECT *, CAST(available AS HUGEINT) * weights <= CAST(weight AS HUGEINT) * rest AS short FROM r),
budget AS (SELECT source, available, weight, CAST(CASE WHEN short THEN available ELSE CAST(weight AS HUGEINT) * (SELECT arg_max(rest, weights) FROM s WHERE NOT short)
  // (SELECT max(weights) FROM s WHERE NOT short) END AS BIGINT) AS budget FROM s UNION ALL SELECT source, available, weight, 0 FROM aw WHERE weight = 0),
taken AS (SELECT doc_id, t.source, n_tokens FROM (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY {s_hash("'5'", "CAST(doc_id AS VARCHAR)")}, doc_id) AS so_far
  FROM sized) t JOIN budget b ON t.source = b.source WHERE so_far <= budget)"""


def _mix(spark, sf):
    docs = sized(spark, sf).select("doc_id", "source", "n_tokens")
    total = docs.agg(F.expr("sum(n_tokens) * 6 div 10").alias("t")).select("t").scalar()
    return docs, M.mixture(docs, "source", "doc_id", "n_tokens", WEIGHTS, total, seed=5), total


@query("mixture", f"WITH {BUDGETS} SELECT * FROM taken")
def mixture(spark, sf):
    return _mix(spark, sf)[1]


@query("mixture_report", f"""
WITH {BUDGETS} SELECT b.source, available, CAST(weight AS BIGINT) AS weight, budget, coalesce("rows", 0) AS "rows", coalesce(taken, 0) AS taken
FROM budget b LEFT JOIN (SELECT source, count(*) AS "rows", CAST(sum(n_tokens) AS BIGINT) AS taken FROM taken GROUP BY source) t ON b.source = t.source""")
def mixture_report(spark, sf):
    docs, mixed, total = _mix(spark, sf)
    return M.mixture_report(docs, mixed, "source", "n_tokens", WEIGHTS, total)


RATIOS = {"src0": 0.8, "src3": 1.5}  # copies per document; 1 in the other topics


def _s_below(x, curve):
    u = f"greatest({x} - {curve.start!r}, 0)"
    e = f"exp({curve.rate!r} * {u})"
    return f"{curve.scale!r} * ({u} * {e} / {curve.rate!r} - 1 / {curve.rate!r} * (({e} - 1) / {curve.rate!r}))"


def _s_expected(ratio):
    c = M.Curve.solve(ratio)
    return f"n * ({_s_below('(CAST(i + 1 AS DOUBLE) / n)', c)} - {_s_below('(CAST(i AS DOUBLE) / n)', c)})"


@query("quality_upsample", f"""
WITH q AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
w AS (SELECT documents.doc_id, source, quality, regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents LEFT JOIN q ON documents.doc_id = q.doc_id),
scored AS (SELECT doc_id, source, coalesce(quality, 0.5) + CASE WHEN len(w) > 0 THEN CAST(len(list_distinct(w)) AS DOUBLE) / len(w) ELSE 0 END AS score FROM w),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM scored),
e AS (SELECT *, CASE source {' '.join(f"WHEN '{s}' THEN {_s_expected(r)}" for s, r in RATIOS.items())} ELSE {_s_expected(1.0)} END AS expected FROM ranked),
c AS (SELECT *, CAST(floor(expected) AS INT) + CASE WHEN {s_hash("'9'", "CAST(doc_id AS VARCHAR)")} / 1152921504606846976.0::DOUBLE < expected - floor(expected) THEN 1 ELSE 0 END AS copies FROM e)
SELECT doc_id, source, round(expected, 6) AS expected, CAST(unnest(range(1, copies + 1)) AS INT) AS copy FROM c""")
def quality_upsample(spark, sf):
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    ratio = F.when(F.size("w") > 0, F.size(F.array_distinct("w")).cast("double") / F.size("w")).otherwise(0)
    docs = table(spark, sf, "documents").select("doc_id", "source", words.alias("w")).select("doc_id", "source", ratio.alias("r"))
    quality = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    scored = docs.join(quality, "doc_id", "left").select("doc_id", "source", (F.coalesce("quality", F.lit(0.5)) + F.col("r")).alias("score"))
    return M.quality_upsample(written(scored, "scored"), "source", "doc_id", "score", ratios=RATIOS, seed=9).select("doc_id", "source", F.round("expected", 6).alias("expected"), "copy")


# The order of pairs and their turns, on the check side.
INTERLEAVED = f"""d AS (SELECT doc_id, source, coalesce(source, chr(0)) AS s, {s_hash("'4'", "CAST(doc_id AS VARCHAR)")} AS h FROM documents),
z AS (SELECT s, coalesce(sum(n) OVER (ORDER BY n DESC, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first, sum(n) OVER () AS total FROM (SELECT s, count(*) AS n FROM d GROUP BY s)),
x AS (SELECT d.*, total, (total + 1) // 2 AS half, first + row_number() OVER (PARTITION BY d.s ORDER BY h, doc_id) - 1 AS j FROM d JOIN z ON d.s = z.s),
p AS (SELECT CASE WHEN j < half THEN j ELSE j - half END AS slot, max(doc_id) FILTER (WHERE j < half) AS ad, max(s) FILTER (WHERE j < half) AS a,
  max(doc_id) FILTER (WHERE j >= half) AS bd, max(s) FILTER (WHERE j >= half) AS b, max(total) AS total FROM x GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN b IS NULL THEN -1
  ELSE (CAST(slot + 1 AS HUGEINT) * 11400714819323198485 % 18446744073709551616) // 2 END, slot) - 1 AS t FROM p),
q AS (SELECT *, coalesce(lag(coalesce(b, a)) OVER (ORDER BY t) = a, false) AS m0, coalesce(lag(a) OVER (ORDER BY t) = a, false) AS m1 FROM o),
c AS (SELECT *, sum(CASE WHEN m0 AND NOT m1 THEN 1 ELSE 0 END) OVER (ORDER BY t) AS changes FROM q),
e AS (SELECT *, last_value(CASE WHEN m0 = m1 THEN 2 * changes + CAST(m0 AS INT) END IGNORE NULLS) OVER (ORDER BY t ROWS UNBOUNDED PRECEDING) AS last FROM c),
f AS (SELECT *, (last + changes - last // 2) % 2 = 1 AS turned, 2 * t - CASE WHEN total % 2 = 1 AND t > 0 THEN 1 ELSE 0 END AS place FROM e),
placed AS (SELECT CASE WHEN turned THEN bd ELSE ad END AS doc_id, CAST(place AS BIGINT) AS position FROM f UNION ALL
  SELECT CASE WHEN turned THEN ad ELSE bd END, CAST(place + 1 AS BIGINT) FROM f)"""


@query("interleave_shuffle", f"WITH {INTERLEAVED} SELECT doc_id, source, position FROM placed JOIN documents USING (doc_id)")
def interleave_shuffle(spark, sf):
    return M.interleave(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", seed=4)


@query("interleave_report", f"""
WITH {INTERLEAVED}, n AS (SELECT source, lag(source) OVER (ORDER BY position) AS prev FROM placed JOIN documents USING (doc_id)),
g AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE source = prev) AS same FROM n GROUP BY source)
SELECT CAST(sum(n) AS BIGINT) AS "rows", CAST(sum(same) AS BIGINT) AS same_source, CAST(greatest(0, 2 * max(n) - sum(n) - 1) AS BIGINT) AS least FROM g""")
def interleave_report(spark, sf):
    return M.neighbour_report(interleave_shuffle(spark, sf), "source")


KEEP, LIMIT = 2, 300


@query("keep_recent", rf"""
WITH RECURSIVE t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
    greatest(1, len(regexp_extract_all(coalesce(text, ''), '<\|eos\|>|[\p{{L}}\p{{N}}_]+|[^\s\p{{L}}\p{{N}}_]'))) AS cost FROM conversations),
s AS (SELECT conv_id, turn, pos, cost AS goal, cost AS total, CAST(0 AS BIGINT) AS context FROM t WHERE pos = 0
  UNION ALL SELECT t.conv_id, t.turn, t.pos, goal, CASE WHEN t.pos = 1 OR total + cost > {LIMIT} THEN goal + cost ELSE total + cost END,
    context + CASE WHEN t.pos > 1 AND total + cost > {LIMIT} THEN 1 ELSE 0 END FROM s JOIN t ON s.conv_id = t.conv_id AND t.pos = s.pos + 1),
k AS (SELECT *, lead(context, {KEEP}) OVER (PARTITION BY conv_id ORDER BY pos) AS later FROM s)
SELECT c.conv_id, c.turn, context, CAST(total AS BIGINT) AS context_tokens, pos = 0 OR later IS NULL OR later <> context AS kept,
  CASE WHEN pos = 0 OR later IS NULL OR later <> context THEN text ELSE '' END AS text
FROM k JOIN conversations c ON k.conv_id = c.conv_id AND k.turn = c.turn""")
def keep_recent(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.size(K.tokens(F.coalesce("text", F.lit("")))).alias("n"))
    return C.blanked(C.keep_recent(turns, "conv_id", "turn", "n", KEEP, LIMIT).drop("n"), "text")


MIN_DOCUMENTS = 5


@query("repeated_lines", f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, i, line, {s_trim('line')} AS k FROM l),
f AS (SELECT k FROM n WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
g AS (SELECT doc_id, count(*) FILTER (WHERE f.k IS NOT NULL) AS removed, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.k IS NULL) AS text FROM n LEFT JOIN f ON n.k = f.k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text, coalesce(removed, 0) AS lines_removed FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id""")
def repeated_lines(spark, sf):
    return L.drop_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"), "text", MIN_DOCUMENTS)


def _s_html(html):
    inside = """(?:[^"''>]|"[^"]*"|''[^'']*'')*"""
    steps = [(r"(?s)<!--.*?(-->|\z)", "''")] + [(rf"(?is)<{name}\b[^>]*>.*?(</{name}\s*>|\z)", "chr(10)") for name in H.SILENT]
    steps += [(rf"(?i)</?({'|'.join(H.BLOCK)})\b{inside}>", "chr(10)"), (rf"</?[A-Za-z!]{inside}>", "''")]
    for pattern, by in steps:
        html = f"regexp_replace({html}, '{pattern}', {by}, 'g')"
    for entity, char in H.ENTITIES.items():
        html = f"replace({html}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    for pattern, by in ((r"[ \t\r\f]+", "' '"), (r" ?\n[ \n]*", "chr(10)"), (r"^[ \n]+|[ \n]+$", "''")):
        html = f"regexp_replace({html}, '{pattern}', {by}, 'g')"
    return html


@query("page_text", f"SELECT page_id, {_s_html('html')} AS text FROM pages")
def page_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", H.html_to_text(F.col("html")).alias("text"))


@query("heuristic_filter", rf"""
WITH t AS (SELECT 'documents' AS source, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'pages', page_id, {_s_html("coalesce(html, '')")} FROM pages),
w AS (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w, list_filter(string_split(text, chr(10)), lambda x: {s_trim('x')} <> '') AS ls FROM t),
m AS (SELECT *, len(w) AS n_words, len(list_distinct(w)) AS u, CASE WHEN len(ls) > 0 THEN CAST(len(list_filter(ls, lambda x: regexp_matches(x, '^\s*([-*+•]|\d{{1,3}}[.)])\s'))) AS DOUBLE) / len(ls) ELSE 0 END AS list_share,
  CASE WHEN len(w) >= 3 THEN 1 - CAST(len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))) AS DOUBLE) / (len(w) - 2) ELSE 0 END AS repeated_share,
  len(list_filter(w, lambda x: x IN ('porn', 'xxx', 'casino'))) AS adult FROM w)
SELECT source, id, CAST(n_words AS BIGINT) AS n_words, round(CASE WHEN n_words > 0 THEN CAST(u AS DOUBLE) / n_words ELSE 0 END, 6) AS unique_share, round(list_share, 6) AS list_share,
  round(repeated_share, 6) AS repeated_share, CASE WHEN {s_trim('text')} = '' THEN 'empty' WHEN n_words < 20 THEN 'short' WHEN n_words > 100000 THEN 'long' WHEN list_share > 0.6 THEN 'lists'
  WHEN repeated_share > 0.3 THEN 'repetition' WHEN u < pow(CAST(n_words AS DOUBLE), 0.55) THEN 'vocabulary' WHEN adult >= 2 THEN 'adult' END AS reason FROM m""")
def heuristic_filter(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), "text")
    pages = table(spark, sf, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), H.html_to_text(F.col("html")).alias("text"))
    judged = H.heuristic_filter(docs.unionByName(pages), "text")
    return judged.select("source", "id", "n_words", *[F.round(c, 6).alias(c) for c in ("unique_share", "list_share", "repeated_share")], "reason")


# Flags of turns and conversations, on the check side.
SFT = rf"""t AS (SELECT conv_id, turn, lower({s_trim("coalesce(role, '')")}) AS role, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') AS w,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, lag(lower({s_trim("coalesce(role, '')")})) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations),
g AS (SELECT *, CASE WHEN len(w) >= 3 THEN 1 - CAST(len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))) AS DOUBLE) / (len(w) - 2) ELSE 0 END AS rep,
  (length(text) - length(replace(text, '<think>', ''))) / 7 AS opens, (length(text) - length(replace(text, '</think>', ''))) / 8 AS closes, strpos(text, '<think>') AS o, strpos(text, '</think>') AS c,
  length(text) - length(regexp_replace(text, '[\x{{4E00}}-\x{{9FFF}}]', '', 'g')) AS han, length(regexp_replace(text, '\s', '', 'g')) AS solid FROM t),
a AS (SELECT conv_id, count(*) AS turns, bool_or(NOT CASE coalesce(prev, '') WHEN '' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
    WHEN 'assistant' THEN role IN ('user', 'tool') WHEN 'tool' THEN role IN ('assistant', 'tool') ELSE false END) AS f1, arg_max(role, pos) <> 'assistant' AS f2,
  bool_or(role = 'assistant' AND (opens <> closes OR (c > 0 AND c < o))) AS f3, bool_or(role = 'assistant' AND {s_trim('text')} = '') AS f4,
  bool_or({' OR '.join(f"contains(lower(text), '{x}')" for x in H.LICENCES)}) AS f5, bool_or({' OR '.join(f"contains(lower(text), '{x}')" for x in H.DEVELOPERS)}) AS f6,
  bool_or(role = 'assistant' AND rep > 0.5) AS f7, bool_or(role = 'assistant' AND han > 0.2 * solid) AS f8 FROM g GROUP BY conv_id),
r AS (SELECT conv_id, turns, list_filter([CASE WHEN f1 THEN 'order' END, CASE WHEN f2 THEN 'unanswered' END, CASE WHEN f3 THEN 'unclosed' END, CASE WHEN f4 THEN 'blank' END,
  CASE WHEN f5 THEN 'licence' END, CASE WHEN f6 THEN 'developer' END, CASE WHEN f7 THEN 'repetition' END, CASE WHEN f8 THEN 'han' END], lambda x: x IS NOT NULL) AS reasons FROM a)"""


@query("sft_filter", f"WITH {SFT} SELECT * FROM r")
def sft_filter(spark, sf):
    return H.sft_filter(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")


@query("sft_filter_counts", f"""
WITH {SFT} SELECT reason, count(*) AS "rows" FROM (SELECT unnest(CASE WHEN len(reasons) > 0 THEN reasons ELSE ['kept'] END) AS reason FROM r) x GROUP BY reason""")
def sft_filter_counts(spark, sf):
    return H.reason_counts(sft_filter(spark, sf))


@query("semantic_dedup")
def semantic_dedup(spark, sf):
    prompts = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return G.semantic_dedup(prompts, "vec_id", "embedding", k=32, rounds=8)[0].select("vec_id", "cluster", F.round("distance", 6).alias("distance"), "representative")


@query("exact_dedup", f"""
WITH n AS (SELECT doc_id, md5(lower({s_trim("regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')")})) AS text_md5 FROM documents)
SELECT doc_id, text_md5, count(*) OVER (PARTITION BY text_md5) AS copies, doc_id = min(doc_id) OVER (PARTITION BY text_md5) AS first FROM n""")
def exact_dedup(spark, sf):
    return S.exact_dedup(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text").drop("text")
