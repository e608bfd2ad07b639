"""Registered queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seawake.llm.alignment import alignment_report
from seawake.llm.collocations import collocations
from seawake.llm.common import read_table, scratch_folder, utf8
from seawake.llm.decontamination import benchmark_overlaps
from seawake.llm.embedding_pairs import embedding_components
from seawake.llm.licenses import scan_licenses
from seawake.llm.mixing import Recipe, mix, word_tokens
from seawake.llm.near_duplicates import jaccard_components
from seawake.llm.quality_lines import line_quality
from seawake.llm.quality_lines import train as train_field
from seawake.llm.repeated_passages import remove_repeats
from seawake.llm.sharding import shard_by_bytes
from seawake.llm.toxicity import toxicity, train
from seawake.llm.token_counts import count_tokens
from seawake.llm.token_files import read_token_files, write_token_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = utf8()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.crc32(body).alias("text_crc32"), body.alias("body"))
    # the digest needs no texts beyond this point: their size and hash travel instead
    slim = docs.select("doc_id", "text_crc32", (F.octet_length("body") + 16).alias("n"), F.xxhash64("body").alias("h"))
    placed = shard_by_bytes(slim, 40, F.col("n"), F.col("h"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = scratch_folder(spark, "token-ids")
    manifest = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), folder, end_id=2)
    return read_token_files(manifest, folder)


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return toxicity(docs, train(docs, labels))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"), width=3, percent=90)


ORACLE["op8_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * c >= 90 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(r.y) AS component_id
FROM w JOIN r ON r.x = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


@query
def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(spark, sf_dir, t) for t in ("documents", "labels"))
    return line_quality(docs, train_field(docs, labels))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return benchmark_overlaps(docs, benchmark)


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    total = docs.agg(F.sum(word_tokens()).alias("n")).first()["n"] or 0
    mixed = mix(docs, Recipe(entropy=0.95, repeats=4.0, budget=total))
    return mixed.select("doc_id", "source", "epoch", "block", "place", word_tokens().alias("n_tokens"), "weight")


@query
def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), length=100)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return alignment_report(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_embedding_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(read_table(spark, sf_dir, "embeddings"), limit=0.9)


ORACLE["op12_embedding_pairs"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), r AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
), n AS (
  SELECT x, count(*) AS n FROM l GROUP BY x
), c AS (
  SELECT x, min(y) AS y FROM r GROUP BY x
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.y AS component_id, v.vec_id = c.y AS kept
FROM v JOIN c ON c.x = v.vec_id LEFT JOIN n ON n.x = v.vec_id
"""


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000)


ORACLE["op13_collocations"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p
), s AS (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k)
), c AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL
), t AS (
  SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang
), d AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS ws, k, f AS a FROM c WHERE k > 1 AND f >= 100
), inside AS (
  SELECT DISTINCT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT lang, ws, a, k, m, unnest(range(1, k - m + 2)) AS i FROM d, (SELECT unnest(range(2, 5)) AS m) WHERE m < k)
), e AS (
  SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = d.lang AND i.phrase = d.phrase AND 100 * i.a >= 100 * d.a)
), cuts AS (
  SELECT lang, phrase, a, cut, array_to_string(ws[1:cut], ' ') AS x, array_to_string(ws[cut + 1:], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM e)
), sc AS (
  SELECT cuts.lang, cuts.phrase, a, cut, l.f AS l, r.f AS r, CAST(n AS BIGINT) AS n,
    CAST((1000::HUGEINT * a * n::HUGEINT) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cuts JOIN c l ON l.lang = cuts.lang AND l.phrase = x JOIN c r ON r.lang = cuts.lang AND r.phrase = y JOIN t ON t.lang = cuts.lang
), b AS (
  SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""
