"""Registered queries of the operators in this subpackage and, where SQL can
express one, its DuckDB oracle.  Every query reads its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary() -> str:
    """Place of the byte-level vocabulary file, the same on every machine."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip_digest
    return round_trip_digest(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity
    return toxicity(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                    read_table(spark, sf_dir, "labels", "doc_id", "toxic"))


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .substrings import substring_dedup
    found = substring_dedup(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), "longest_repeat")


def _repeat_levels(levels: int) -> str:
    """CTEs ``w0, w1, ...``: windows of 50 * 2 ** j words, from two windows of
    the level below that are shared by several documents."""
    parts = []
    for j in range(1, levels):
        half = 50 << (j - 1)
        parts.append(f"""
c{j} AS (SELECT * FROM w{j - 1} WHERE s IN (SELECT s FROM w{j - 1} GROUP BY s HAVING min(doc_id) < max(doc_id))),
w{j} AS (SELECT a.doc_id, a.i, md5(a.s || b.s) AS s FROM c{j} a JOIN c{j} b ON a.doc_id = b.doc_id AND b.i = a.i + {half}),""")
    return "".join(parts)


def _repeat_depth(levels: int) -> str:
    each = " UNION ALL ".join(
        f"SELECT DISTINCT x.doc_id, {50 << j} AS l FROM w{j} x JOIN (SELECT s, min(doc_id) AS m FROM w{j} GROUP BY s) y "
        f"ON x.s = y.s AND y.m < x.doc_id" for j in range(levels))
    return f"depth AS (SELECT doc_id, max(l) AS l FROM ({each}) GROUP BY doc_id),"


# levels up to 25 600 words: documents have 20 000 at most
ORACLES["op4_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w0 AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
""" + _repeat_levels(10) + _repeat_depth(10) + r"""
least AS (SELECT s, min(doc_id) AS m FROM w0 GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p
  FROM (SELECT w0.doc_id, w0.i, unnest(range(0, 50)) AS j FROM w0 JOIN least ON w0.s = least.s AND m < w0.doc_id)),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT word.doc_id, string_agg(word.word, ' ' ORDER BY word.p) AS t
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p
  WHERE gone.p IS NULL GROUP BY word.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256, CAST(coalesce(depth.l, 0) AS BIGINT) AS longest_repeat
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN depth ON depth.doc_id = w.doc_id
"""


@query
def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_links
    found = jaccard_links(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "class_id", "n_links", "component_id", "kept")


ORACLES["op2_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM shared JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE CAST(k AS DOUBLE) / CAST(nx.n + ny.n - k AS DOUBLE) >= 0.8),
reach AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x),
cnt AS (SELECT x, count(*) AS k FROM link GROUP BY x),
cls AS (SELECT text, min(doc_id) AS m FROM w WHERE len(ws) > 0 GROUP BY text)
SELECT w.doc_id, coalesce(cls.m, w.doc_id) AS class_id, CAST(coalesce(cnt.k, 0) AS BIGINT) AS n_links,
       coalesce(comp.c, w.doc_id) AS component_id, coalesce(comp.c, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN cls ON cls.text = w.text LEFT JOIN cnt ON cnt.x = w.doc_id LEFT JOIN comp ON comp.x = w.doc_id
"""


@query
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets_digest
    return secrets_digest(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mixed_rates
    return mixed_rates(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"),
                       read_table(spark, sf_dir, "labels", "doc_id"))


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .attribution import token_counts
    found = token_counts(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())
    return found.select("doc_id", "section", "start", "end", "n_tokens", "n_crossing")


@query
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import chat_format
    return chat_format(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


ORACLES["op1_chat_format"] = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT conv_id, i, n, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s FROM p),
pre AS (SELECT a.conv_id, a.i, a.n, string_agg(b.s, '' ORDER BY b.i) AS s
        FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.i <= a.i GROUP BY a.conv_id, a.i, a.n),
whole AS (SELECT conv_id, n, s FROM pre WHERE i = n)
SELECT conv_id, CAST(0 AS INTEGER) AS segment, CAST(n AS BIGINT) AS n_turns, s AS text
FROM whole
WHERE NOT EXISTS (SELECT 1 FROM pre WHERE pre.i = whole.n AND pre.s = whole.s
                  AND (pre.n > whole.n OR (pre.n = whole.n AND pre.conv_id < whole.conv_id)))
"""


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import embedding_links
    return embedding_links(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLES["op7_embedding_dedup"] = r"""
WITH RECURSIVE c AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings WHERE embedding IS NOT NULL),
norm AS (
  SELECT vec_id, sqrt(sum(x * x)) AS norm FROM c GROUP BY vec_id
  HAVING count(x) = count(*) AND bool_and(isfinite(x)) AND sum(x * x) > 0),
v AS (SELECT e.vec_id, CAST(e.embedding AS DOUBLE[]) AS v, norm FROM embeddings e JOIN norm USING (vec_id)),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95),
reach AS (SELECT x, y FROM link UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
comp AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x),
cnt AS (SELECT x, count(*) AS k FROM link GROUP BY x)
SELECT e.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, coalesce(c, e.vec_id) AS component_id,
       coalesce(c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN comp ON comp.x = e.vec_id LEFT JOIN cnt ON cnt.x = e.vec_id
"""


@query
def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import integer_vectors, top_k
    vectors = integer_vectors(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


ORACLES["op9_topk"] = r"""
WITH c AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings WHERE embedding IS NOT NULL),
bad AS (SELECT DISTINCT vec_id FROM c WHERE x IS NULL OR NOT isfinite(x)),
v AS (SELECT vec_id, i, CAST(floor(256 * x) AS BIGINT) AS x FROM c WHERE vec_id NOT IN (SELECT vec_id FROM bad)),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(sum(q.x * d.x) AS BIGINT) AS score
      FROM v q JOIN v d ON q.i = d.i AND q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op11_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import written_and_read
    return written_and_read(read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling import spelling_variants
    return spelling_variants(read_table(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .collocations import collocations
    return collocations(read_table(spark, sf_dir, "documents", "text", "lang"))


ORACLES["op13_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS ws
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
g AS (
  SELECT lang, 1 AS k, unnest(ws) AS phrase FROM pieces
  UNION ALL
  SELECT lang, 2, array_to_string(ws[i:i + 1], ' ') FROM (SELECT lang, ws, unnest(range(1, len(ws))) AS i FROM pieces)
  UNION ALL
  SELECT lang, 3, array_to_string(ws[i:i + 2], ' ') FROM (SELECT lang, ws, unnest(range(1, len(ws) - 1)) AS i FROM pieces)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY lang, k, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:], ' ') AS q
  FROM c, (VALUES (1), (2)) AS v(j) WHERE j < k),
scored AS (
  SELECT cuts.*, x.f AS l, y.f AS r, 1000000 * a * a // (x.f * y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = p AND x.k = j JOIN f y ON y.lang = cuts.lang AND y.phrase = q AND y.k = cuts.k - j),
low AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS o FROM scored) WHERE o = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[i:i + 1], ' ') AS phrase, a FROM c, (VALUES (1), (2)) AS v(i) WHERE k = 3) GROUP BY lang, phrase),
kept AS (
  SELECT low.* FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.phrase = low.phrase AND low.k = 2
  WHERE longer.a IS NULL OR 100 * longer.a < 50 * low.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= 2000
"""
