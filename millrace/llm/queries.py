"""The registered queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, html_text, mixing, near_join, near_vectors, quality, repeats, scoring, token_files, top_k
from .common import load

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(load(spark, sf_dir, "documents"), tokenizer_path())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.grade(docs, quality.train(docs, load(spark, sf_dir, "labels"))).drop("text")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.stored(load(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("n_copies")


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(load(spark, sf_dir, "embeddings"))


def op6_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(load(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(load(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(load(spark, sf_dir, "embeddings"))


def op8_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_join(load(spark, sf_dir, "documents")).drop("class_id")


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_near_vectors": op5_near_vectors,
    "op6_scoring": op6_scoring,
    "op7_html_text": op7_html_text,
    "op8_near_join": op8_near_join,
    "op9_top_k": op9_top_k,
    "op10_repeats": op10_repeats,
}

# -- SQL equivalents, over whole tables --------------------------------------------------------------------------

_size = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
_mixing = rf"""
WITH d AS (SELECT doc_id, source, {_size}::BIGINT AS size, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key FROM documents),
s AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source)),
w AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][(rank - 1) % 3 + 1] AS weight, (3 * source_size)::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM f),
t AS (SELECT source, rank, source_size, CASE WHEN fill < level THEN cap ELSE (SELECT arg_min(level, (fill, rank)) FROM l WHERE NOT fill < level) * weight END AS target FROM l),
p AS (SELECT d.doc_id, d.size, d.key, t.rank, t.source_size, t.target, sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key % 4096, d.key, d.doc_id)::BIGINT AS through FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, (copy * source_size + through)::DOUBLE / target AS finish FROM p, range(3) AS r(copy) WHERE size > 0 AND target > 0),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, rank, key % 4096, key, doc_id, copy) AS total FROM q),
n AS (SELECT doc_id, count(*) AS copies FROM c WHERE total <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT p.doc_id, p.size, p.source_size, p.target, (p.size * coalesce(n.copies, 0))::BIGINT AS taken FROM p LEFT JOIN n ON p.doc_id = n.doc_id"""

_search = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""

_near = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g FROM w),
c AS (SELECT min(doc_id) AS rep, g, len(g) AS n FROM g WHERE len(g) > 0 GROUP BY g),
x AS (SELECT rep, n, unnest(g) AS shingle FROM c),
p AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(node, seen) AS (SELECT rep, rep FROM c UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
m AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT g.doc_id, len(g.g)::BIGINT AS n_shingles, coalesce(m.component, g.doc_id) AS component_id FROM g LEFT JOIN c ON c.g = g.g LEFT JOIN m ON m.node = c.rep"""

_vectors = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.98::DOUBLE),
r(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.b, r.seen FROM r JOIN p ON p.a = r.node),
m AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept FROM embeddings e JOIN m ON m.node = e.vec_id"""

#: The vector join finds pairs with a calibrated probability; on tables where it finds all, the SQL agrees.
ORACLES: dict[str, str] = {"op4_mixing": _mixing, "op5_near_vectors": _vectors, "op8_near_join": _near, "op9_top_k": _search}
