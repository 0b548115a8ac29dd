"""Registered queries of this package and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit, bwt_dedup, chosen_path, collocations, common, decontaminate, exact_dedup, html_text, license_scan, periodic_runs, piece_viterbi, quality, token_blocks, toxicity


def _scored(spark: SparkSession, sf_dir: str, model, label: str, mod: int, rest: int) -> DataFrame:
    docs, labels = common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    may = labels.where(~common.held_out(F.col("doc_id"), mod, rest)).select("doc_id", F.col(label).alias("label"))
    return model.score(docs, may).select("doc_id", common.held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of repositories: source/lang/doc_id.txt; every 50th is a licence file of its source or language."""
    docs, key = common.documents(spark, sf_dir), F.col("doc_id")
    folder = F.when(key % 100 == 0, F.col("source")).otherwise(F.concat_ws("/", "source", "lang"))
    path = F.when(key % 50 == 0, F.concat(folder, F.lit("/LICENSE-"), key)).otherwise(F.concat_ws("/", "source", "lang", F.concat(key, F.lit(".txt"))))
    return license_scan.scan(docs.select(path.alias("path"), "text")).select("path", "license", F.round("score", 3).alias("score"), "inherited_from")


OP1_SQL = r"""
WITH files AS (
  SELECT CASE WHEN doc_id % 100 = 0 THEN source || '/LICENSE-' || doc_id
              WHEN doc_id % 50 = 0 THEN source || '/' || lang || '/LICENSE-' || doc_id
              ELSE source || '/' || lang || '/' || doc_id || '.txt' END AS path, text FROM documents),
templates(template, license, body) AS (VALUES %(templates)s),
tok AS (SELECT path, regexp_extract_all(lower(text), '%(term)s') AS terms FROM files),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT path, unnest(terms) AS term FROM tok) GROUP BY term),
lines AS (SELECT path, k - 1 AS line, regexp_extract_all(lower(body), '%(term)s') AS terms
          FROM (SELECT path, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM files)),
windows AS (SELECT path, 0 AS size, 0 AS w, terms FROM lines WHERE regexp_matches(path, '(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$')
            UNION ALL SELECT path, 1, line, terms FROM lines
            UNION ALL SELECT path, s, line // (s // 2) - d, terms FROM lines, (VALUES (4), (16)) a(s), (VALUES (0), (1)) b(d) WHERE line // (s // 2) >= d),
units AS (SELECT path AS a, size AS b, w AS c, '' AS license, unnest(terms) AS term FROM windows
          UNION ALL SELECT NULL, -1, template, license, unnest(regexp_extract_all(lower(body), '%(term)s')) FROM templates),
tf AS (SELECT a, b, c, license, term, count(*) AS tf FROM units GROUP BY ALL),
w AS (SELECT a, b, c, license, tf.term, tf * ln(1 + (SELECT count(*) FROM files)::DOUBLE / coalesce(df, 1)) AS w FROM tf LEFT JOIN df ON tf.term = df.term),
v AS (SELECT a, b, c, license, term, w / sqrt(sum(w * w) OVER (PARTITION BY a, b, c)) AS w FROM w),
cosine AS (SELECT x.a AS path, x.b, x.c, t.license, t.c AS template, sum(x.w * t.w) AS cosine
           FROM v x JOIN v t ON x.term = t.term AND t.b = -1 AND x.b <> -1 GROUP BY ALL),
scored AS (SELECT path, license, round(max(cosine), 6) AS score FROM cosine WHERE cosine >= %(least)s GROUP BY ALL),
own AS (SELECT files.path, license, score FROM files LEFT JOIN (
          SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY path ORDER BY score DESC, license) = 1) s ON files.path = s.path),
speaks AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, license FROM own
           WHERE license IS NOT NULL AND regexp_matches(path, '/LICENSE')
           QUALIFY row_number() OVER (PARTITION BY regexp_extract(path, '^(.*)/[^/]*$', 1) ORDER BY score DESC, license) = 1)
SELECT own.path, coalesce(own.license, near.license, top.license) AS license, round(own.score, 3) AS score,
       CASE WHEN own.license IS NOT NULL THEN NULL ELSE coalesce(near.folder, top.folder) END AS inherited_from
FROM own LEFT JOIN speaks near ON regexp_extract(own.path, '^(.*)/[^/]*$', 1) = near.folder
         LEFT JOIN speaks top ON split_part(own.path, '/', 1) = top.folder
"""
OP1_SQL = OP1_SQL.replace("%(templates)s", ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(license_scan.TEMPLATES)))
OP1_SQL = OP1_SQL.replace("%(term)s", license_scan.TERM).replace("%(least)s", str(license_scan.MIN_SCORE))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, quality, "quality", 4, 2)


def op3_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_blocks.write_and_read(common.documents(spark, sf_dir))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return html_text.extract(pages).select("page_id", "text", (F.size(F.split("text", "\n"))).cast("long").alias("n_lines"), F.octet_length("text").cast("long").alias("n_bytes"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("row")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir, toxicity, "toxic", 3, 1)


def op7_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.remove_repeats(common.documents(spark, sf_dir))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_viterbi.round_trips(common.documents(spark, sf_dir))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(common.documents(spark, sf_dir))


OP9_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op10_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(common.documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.report(common.documents(spark, sf_dir))


OP11_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase FROM w, range(1, 5) t(m) WHERE len(w) >= m),
f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
cuts AS (SELECT c.*, k, h.f AS l, t.f AS r, (2000000::HUGEINT * a) // (h.f + t.f) AS score FROM c, range(1, 4) x(k)
         JOIN f h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:k], ' ') JOIN f t ON t.lang = c.lang AND t.phrase = array_to_string(w[k + 1:], ' ') WHERE k < c.m),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_of AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(a) AS longer FROM c, range(2, 4) y(s), range(1, 4) z(i) WHERE s < m AND i + s - 1 <= m GROUP BY ALL)
SELECT q.lang, row_number() OVER (PARTITION BY q.lang ORDER BY score DESC, a DESC, encode(q.phrase)) AS rank, q.phrase, a, l, r, n, score::BIGINT AS score
FROM lowest q JOIN totals ON totals.lang = q.lang LEFT JOIN inner_of i ON i.lang = q.lang AND i.phrase = q.phrase
WHERE coalesce(100::HUGEINT * longer < 80::HUGEINT * a, TRUE) QUALIFY rank <= 2000
"""


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digests(periodic_runs.with_loops(common.documents(spark, sf_dir)))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit.packed_documents(common.documents(spark, sf_dir))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_quality": op2_quality,
    "op3_token_blocks": op3_token_blocks,
    "op4_html_text": op4_html_text,
    "op5_decontaminate": op5_decontaminate,
    "op6_toxicity": op6_toxicity,
    "op7_repeated_bytes": op7_repeated_bytes,
    "op8_pieces": op8_pieces,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_near_join": op10_near_join,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_best_fit": op13_best_fit,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op1_license_scan": OP1_SQL, "op9_exact_dedup": OP9_SQL, "op11_collocations": OP11_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL
