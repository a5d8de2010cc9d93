"""The queries of this subpackage over whole tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    blocks, brown, centroids, collocations, fingerprints, lines, packing, quality, repeats, replies, sharding, simhash, unigram,
)  # fmt: skip
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


@query
def op1_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.edited_fingerprints(read(spark, folder, "documents"))


@query
def op2_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign_shards(read(spark, folder, "documents"), shards=24)


@query
def op3_token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return blocks.encoded_documents(read(spark, folder, "documents"))


@query
def op8_best_fit(spark: SparkSession, folder: str) -> DataFrame:
    placed = packing.packed_documents(read(spark, folder, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op6_ngram_ratio(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents")
    ratio = quality.fit_ratio(documents, read(spark, folder, "labels"))
    return quality.judged(documents, ratio)


@query
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"), width=3, distance=2)


@query
def op10_recompression(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.removal_report(read(spark, folder, "documents"), window=35)


@query
def op4_brown_classes(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return brown.scored_documents(read(spark, folder, "documents"), held_out)


@query
def op9_unigram_viterbi(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.round_trips(read(spark, folder, "documents"), unigram.load_vocabulary())


#: The conversation that is formatted besides the table's own.
ODD_TEXT = r"\### Assistant: </turn> ok"


@query
def op7_reply_paths(spark: SparkSession, folder: str) -> DataFrame:
    odd = spark.createDataFrame(
        [(-7, 0, "user", ODD_TEXT), (-7, 1, "assistant", ODD_TEXT)], "conv_id long, turn long, role string, text string"
    )
    rows = read(spark, folder, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    return replies.conversation_digests(rows.unionByName(odd))


_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '### ', '#\\## '), '</turn>', '<\\/turn>')"
SQL["op7_reply_paths"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{ODD_TEXT}'), (-7, 1, 'assistant', '{ODD_TEXT}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(replace({_ESCAPED.format('role')}, ': ', ':\\ ')) + 2 + length({_ESCAPED.format('text')}) + 9)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

SQL["op10_recompression"] = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(ws) - 33)) AS i,
    unnest(list_transform(range(1, len(ws) - 33), lambda i: md5(array_to_string(ws[i:i + 34], ' ')))) AS h
  FROM texts WHERE len(ws) >= 35),
again AS (SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS j FROM again, range(35) t(k)),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM texts),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS text, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""


@query
def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.kept_digests(read(spark, folder, "documents"), min_documents=2, min_chars=10)


@query
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(read(spark, folder, "documents"), longest=5, least=100, top=2000)


@query
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clustered(read(spark, folder, "embeddings"), dimensions=64, scale=64, k=16, rounds=3)


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL["op11_line_dedup"] = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(range(len(ls))) AS pos, unnest(ls) AS line FROM split),
keyed AS (
  SELECT *, translate(trim(line, {_BLANKS}), '{lines.CAPITALS}', '{lines.CAPITALS.lower()}') AS k FROM lines),
common AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT doc_id, pos, line, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

SQL["op12_collocations"] = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-]')) AS piece FROM texts),
words AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase
  FROM words, range(1, 6) lengths(m) WHERE len(ws) >= m),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
left_over AS (
  SELECT * FROM counts c WHERE m >= 2 AND NOT EXISTS (
    SELECT 1 FROM counts d WHERE d.lang = c.lang AND d.m > c.m AND 100 * d.f >= 100 * c.f
      AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS before,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS after
  FROM left_over, range(1, 5) ks(k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, l.f AS l, r.f AS r, n,
    ((1000::HUGEINT * c.a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.before
    JOIN counts r ON r.lang = c.lang AND r.phrase = c.after JOIN totals t ON t.lang = c.lang),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""


def _centroid_sql(rounds: int) -> str:
    away = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    steps = [
        """WITH kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < 16)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""
d{i} AS (SELECT vec_id, k.v, c, {away} AS d FROM kept k, c{i} c),
a{i} AS (SELECT * FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if i < rounds:
            steps.append(f"""
m{i} AS (SELECT c, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x
  FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS pos FROM a{i}) GROUP BY c, pos),
n{i} AS (SELECT c, list(x ORDER BY pos) AS v FROM m{i} GROUP BY c),
c{i + 1} AS (SELECT c, coalesce(n{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN n{i} USING (c))""")
    return ",".join(steps) + f"""
SELECT vec_id, c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(f.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} f USING (c)"""


SQL["op13_centroids"] = _centroid_sql(3)
