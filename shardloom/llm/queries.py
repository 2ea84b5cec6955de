"""One query for each operator of this package, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from shardloom.llm import bpe, chat, exact_dedup, fingerprint, line_dedup, lm_score, mixing, pii, quality, simhash
from shardloom.llm.common import table


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def lm_scoring(spark, sf_dir):
    """Scores all documents; the target is the documents labelled good and not toxic, the background all documents."""
    labels = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0")
    return lm_score.lm_scores(table(spark, sf_dir, "documents"), labels)


def quality_classifier(spark, sf_dir):
    """Judges all documents by models fitted on all documents labelled good."""
    docs = table(spark, sf_dir, "documents")
    return quality.judged(docs, quality.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])


def bpe_roundtrip(spark, sf_dir, vocabulary: str | None = None):
    """Encodes and decodes every document; digests of the ids and of the decoded text."""
    path = vocabulary or _vocabulary("byte_bpe_50k.json")
    both = bpe.bpe_roundtrip(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def exact(spark, sf_dir):
    """Exact groups of all documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def near(spark, sf_dir):
    """Near groups of all documents: 4-word shingles, at most 4 differing bits."""
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=4, distance=4)


def document_fingerprints(spark, sf_dir):
    """Fingerprints of all documents, of their edited texts, and likeness to both neighbours."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def lines_dedup(spark, sf_dir):
    """All documents without the blocks of lines that align with earlier documents."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def mixing_sources(spark, sf_dir):
    """Mixes all documents: weights 5, 2, 1 over the sources, at most three copies."""
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def personal_data(spark, sf_dir):
    """Personal data of all documents, and the terms that give it away."""
    rows = pii.find_spans(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[pii.counted(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"), pii.written(F.concat("base", "further")).alias("spans"))


def chat_formatting(spark, sf_dir):
    """All conversations and one that holds control strings, formatted; read back from the windows alone."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hard).alias("text"))
    done = chat.windows(turns.unionByName(own))
    new = F.filter(chat.read_turns(F.col("formatted")), lambda t: ~t["again"])
    told = F.array_join(F.transform(new, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = done.select("conv_id", F.struct("window", F.size(new).cast("long").alias("n"), told.alias("told"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("loss"), F.char_length("formatted").cast("long").alias("chars")).alias("w"))
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"))
    total = lambda name: F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x[name])
    joined = lambda name: F.array_join(F.transform("w", lambda x: x[name]), "")
    return rows.select("conv_id", total("n").alias("n_turns"), F.sha2(joined("told"), 256).alias("turns_sha256"), F.char_length(joined("loss")).cast("long").alias("loss_chars"), F.sha2(joined("loss"), 256).alias("loss_sha256"), total("chars").alias("formatted_chars"))


MIX_SQL = r"""
WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS s,
  coalesce(length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')), 0) AS size,
  CAST('0x' || substr(sha256('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents),
k AS (SELECT *, least(20, CASE WHEN size > 0 THEN length(bin(size)) ELSE 0 END) AS k FROM d),
b AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * k) AS BIGINT) AS digits FROM k GROUP BY s),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY s) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM b),
o AS (SELECT *, sum(source_size) OVER () AS alls, sum(w) OVER () AS allw,
  coalesce(sum(source_size) OVER k, 0) AS sb, coalesce(sum(w) OVER k, 0) AS wb
  FROM w WINDOW k AS (ORDER BY source_size / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CAST(alls - 3 * sb AS DOUBLE) / CAST(allw - wb AS DOUBLE) AS lev FROM o),
v AS (SELECT min_by(lev, wb) AS level FROM l WHERE lev * w <= 3 * source_size AND source_size > 0),
t AS (SELECT s, source_size, digits, least(CAST(3 * source_size AS DOUBLE), coalesce(level * w, CAST(3 * source_size AS DOUBLE))) AS target FROM l, v),
h AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN (target - whole * source_size) / source_size ELSE 0.0::DOUBLE END AS p,
  CASE WHEN source_size > 0 THEN digits::DOUBLE / source_size::DOUBLE ELSE 0.0::DOUBLE END AS mean FROM h),
i AS (SELECT k.*, p.p + p.p * (1 - p.p) * 1.0::DOUBLE * (k.k - p.mean) / 20 AS pi FROM k JOIN p USING (s) WHERE p.p > 0),
q AS (SELECT s, doc_id, size, (u / (1 - u)) / (pi / (1 - pi)) AS q FROM i),
g AS (SELECT s, q, doc_id, size, sum(size) AS words FROM q GROUP BY ALL),
f AS (SELECT g.*, sum(words) OVER (PARTITION BY s ORDER BY q, doc_id NULLS LAST, size) - words / 2 > target - whole * source_size AS full_ FROM g JOIN p USING (s)),
c AS (SELECT s, doc_id, size, NOT bool_or(full_) OVER (PARTITION BY s ORDER BY q, doc_id NULLS LAST, size) AS more FROM f)
SELECT d.doc_id, d.size, source_size, target,
  CAST((whole + CASE WHEN more THEN 1 ELSE 0 END) * d.size AS BIGINT) AS taken,
  CAST(whole + CASE WHEN more THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN p USING (s) LEFT JOIN c ON c.s = d.s AND c.doc_id IS NOT DISTINCT FROM d.doc_id AND c.size = d.size
"""

PII_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
k(o, kind, pat) AS (VALUES (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'),
  (3, 'card', '[0-9](?:[\x20-]?[0-9])+'), (4, 'phone', '\+[0-9][\x20().0-9-]+[0-9]'), (5, 'term', '[\p{L}\p{N}]+')),
u AS (SELECT r, o, kind, unnest(regexp_extract_all(text, pat)) AS hit, unnest(regexp_split_to_array(text, pat)) AS gap,
  unnest(generate_series(1, len(regexp_split_to_array(text, pat)))) AS i FROM d, k),
p AS (SELECT r, o, kind, hit, CAST(sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY r, o ORDER BY i) AS BIGINT) AS "end" FROM u),
v AS (SELECT r, o, kind, hit, "end" - length(hit) AS start, "end", regexp_replace(hit, '[^0-9]', '', 'g') AS digits FROM p WHERE hit IS NOT NULL),
base AS (SELECT * FROM v WHERE o = 1
  OR (o = 2 AND list_min(list_transform(string_split(hit, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) <= 3 AND CAST('0' || ltrim(x, '0') AS BIGINT) <= 255 THEN 1 ELSE 0 END)) = 1)
  OR (o = 3 AND length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda x, j: CASE WHEN j % 2 = 1 THEN CAST(x AS BIGINT)
    WHEN CAST(x AS BIGINT) > 4 THEN 2 * CAST(x AS BIGINT) - 9 ELSE 2 * CAST(x AS BIGINT) END)) % 10 = 0)
  OR (o = 4 AND length(digits) BETWEEN 9 AND 15)),
n AS (SELECT count(*) AS n FROM d),
e AS (SELECT DISTINCT r, kind || ':' || hit AS e FROM base),
t AS (SELECT DISTINCT r, lower(hit) AS t FROM v WHERE o = 5),
ce AS (SELECT e, count(*) AS ce FROM e GROUP BY 1 HAVING count(*) >= 2),
ct AS (SELECT t, count(*) AS ct FROM t GROUP BY 1),
cet AS (SELECT e, t, count(*) AS cet FROM e JOIN ce USING (e) JOIN t USING (r) GROUP BY 1, 2 HAVING count(*) >= 2),
disc AS (SELECT e, t, ln(n * cet::DOUBLE / (ce::DOUBLE * ct)) / ln(n / ce::DOUBLE) AS x FROM cet JOIN ce USING (e) JOIN ct USING (t), n WHERE ce < n),
flag AS (SELECT r, t, max(x) AS x FROM e JOIN disc USING (e) JOIN t USING (r, t) WHERE x >= 0.9 - 1e-9 GROUP BY 1, 2),
more AS (SELECT v.r, CASE WHEN x >= 1 - 1e-9 THEN 'removed' ELSE 'generalised' END AS kind, v.start, v."end" FROM v JOIN flag ON v.r = flag.r AND lower(v.hit) = flag.t
  WHERE v.o = 5 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = v.r AND b.start < v."end" AND v.start < b."end")),
b AS (SELECT r, count(*) FILTER (o = 1) AS n_email, count(*) FILTER (o = 2) AS n_ip, count(*) FILTER (o = 3) AS n_card, count(*) FILTER (o = 4) AS n_phone,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY o, start) AS s FROM base GROUP BY 1),
m AS (SELECT r, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY kind, start) AS s FROM more GROUP BY 1)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(b.s, '')) AS base_sha256, concat_ws(',', b.s, m.s) AS spans FROM d LEFT JOIN b USING (r) LEFT JOIN m USING (r)
"""

CHAT_SQL = r"""
WITH a AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
b AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 2 AS tokens,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS nth FROM a),
c AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY nth) AS BIGINT) - tokens AS pos,
  coalesce(max(CASE WHEN nth = 1 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), -1) AS system FROM b),
d AS (SELECT *, system >= 0 AND nth = 1 AS lead, greatest(1, 512 - 128 - greatest(system, 0)) AS room,
  CASE WHEN system >= 0 AND nth = 1 THEN 0 ELSE pos - greatest(system, 0) END AS start FROM c),
e AS (SELECT *, CASE WHEN lead THEN 0 ELSE start // room * 2 + CASE WHEN start > start // room * room AND start + tokens > (start // room + 1) * room THEN 1 ELSE 0 END END AS place FROM d),
f AS (SELECT *, CASE WHEN nth = 1 OR place > lag(place) OVER (PARTITION BY conv_id ORDER BY nth) THEN 1 ELSE 0 END AS opens FROM e),
g AS (SELECT *, sum(opens) OVER (PARTITION BY conv_id ORDER BY nth) - 1 AS win,
  length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + 1 + length(replace(replace(text, '\', '\b'), '<', '\l')) + 8 AS chars FROM f),
h AS (SELECT x.conv_id, x.nth, count(y.nth) AS again FROM g x LEFT JOIN g y ON x.conv_id = y.conv_id AND y.nth BETWEEN x.nth + 1 AND x.nth + 4
  AND y.opens = 1 AND y.start - x.start <= least(128, greatest(0, 512 - greatest(x.system, 0) - y.tokens)) AND NOT x.lead GROUP BY 1, 2),
i AS (SELECT conv_id, max(win) AS wins FROM g GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(6 + chars + (again + CASE WHEN lead THEN wins ELSE 0 END) * (7 + chars)) AS BIGINT) AS formatted_chars
FROM g JOIN h USING (conv_id, nth) JOIN i USING (conv_id) GROUP BY conv_id
"""

EXACT_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS r FROM n)
SELECT doc_id, keep_id, group_size, r = 1 AS kept, text_sha256 FROM g
"""

QUERIES = {
    "op1_lm_scoring": lm_scoring,
    "op2_bpe": bpe_roundtrip,
    "op3_simhash": near,
    "op4_fingerprints": document_fingerprints,
    "op5_line_dedup": lines_dedup,
    "op6_quality": quality_classifier,
    "op7_mixing": mixing_sources,
    "op8_exact_dedup": exact,
    "op9_chat": chat_formatting,
    "op10_pii": personal_data,
}
ORACLE_SQL = {
    "op7_mixing": MIX_SQL,
    "op8_exact_dedup": EXACT_SQL,
    "op9_chat": CHAT_SQL,
    "op10_pii": PII_SQL,
}
