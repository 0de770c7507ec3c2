"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, exact_dedup, fingerprints, langid, line_dedup, lm_scoring, mixing, near_dedup, packing, quality, substring_dedup, token_rollup, vector_codes
from .shared import prepare, shared_dir, table


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return operator(table(spark, sf_dir, "documents"))

    return query


def _pack(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, keep_ids=False)


def _near(docs: DataFrame) -> DataFrame:
    return near_dedup.near_duplicates(docs, near_dedup.ForestConfig(width=3, percent=85))


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_rollup.token_counts(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")


def _compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return vector_codes.compressed_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": _on_documents(substring_dedup.repeated_passages),
        "op2_document_fingerprints": _on_documents(fingerprints.edited_fingerprints),
        "op3_token_counts": _count_tokens,
        "op4_quality_classifier": _score,
        "op5_best_fit_packing": _on_documents(_pack),
        "op6_minhash_near_dedup": _on_documents(_near),
        "op7_mix_sources": _on_documents(mixing.mix_sources),
        "op8_exact_dedup": _on_documents(exact_dedup.exact_duplicates),
        "op9_line_dedup": _on_documents(line_dedup.line_report),
        "op10_language_id": _on_documents(langid.predict_languages),
        "op11_vector_codes": _compress,
        "op12_lm_scoring": _on_documents(lm_scoring.score_documents),
        "op13_tokenizer_alignment": _on_documents(alignment.align_tokenizers),
        "pipeline": pipeline,
    }


_WORDS = r"'[^\x20\x09-\x0D]+'"

EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""

NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS size FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common_n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common_n >= 85 * (na.size + nb.size - common_n)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.seen)
SELECT d.doc_id, coalesce(n.size, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id) c ON c.doc_id = d.doc_id
"""


#: Lines are at distance 1 when they share a one-character deletion at one place (equal
#: lengths), or when a deletion of the longer is the shorter.
LINE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), f AS (SELECT line, min({'d': doc_id, 'n': line_no}) AS first FROM l WHERE trim(line, ' ') <> '' GROUP BY line),
g AS (SELECT line, first, length(line) AS n FROM f),
v AS (SELECT line, first, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS h FROM (SELECT line, first, unnest(range(1, n + 1)) AS i FROM g)),
s AS (SELECT h, i, min(first) AS best FROM v GROUP BY h, i HAVING count(*) > 1),
near AS (
  SELECT v.line FROM v JOIN s ON v.h = s.h AND v.i = s.i WHERE s.best < v.first
  UNION SELECT v.line FROM v JOIN g ON v.h = hash(g.line) WHERE g.first < v.first
  UNION SELECT g.line FROM v JOIN g ON v.h = hash(g.line) WHERE v.first < g.first
), t AS (
  SELECT l.doc_id, coalesce({'d': l.doc_id, 'n': l.line_no} <> f.first, false) AS eq, near.line IS NOT NULL AS nr
  FROM l LEFT JOIN f ON l.line = f.line LEFT JOIN near ON l.line = near.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE eq) AS equal_dropped, count(*) FILTER (WHERE nr AND NOT eq) AS near_dropped,
  count(*) FILTER (WHERE NOT nr AND NOT eq) AS kept_lines
FROM t GROUP BY doc_id
"""


def vector_code_sql(config: vector_codes.CodeConfig = vector_codes.CodeConfig()) -> str:
    """All rounds, unrolled: ``a`` assigns parts to entries, ``c`` holds the codebooks."""
    n = config.parts
    steps = [
        f"""k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({config.scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT vec_id, label, part, list_slice(v, part * len(v) // {n} + 1, (part + 1) * len(v) // {n}) AS x FROM k, range({n}) AS r(part))""",
        f"""c0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {config.entries}))""",
    ]
    for r in range(config.rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p.part, any_value(p.x) AS x,
  min({{'d': list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))), 'e': e}}) AS m FROM p JOIN c{r} c ON p.part = c.part GROUP BY vec_id, p.part)""")
        if r < config.rounds:
            steps.append(f"""s{r} AS (SELECT part, m.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, (SELECT max(len(x)) FROM p) + 1) AS q(i) GROUP BY ALL),
u{r} AS (SELECT part, e, list(CAST((s - (s % n + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM s{r} GROUP BY part, e),
c{r + 1} AS MATERIALIZED (SELECT part, e, coalesce(u.x, c.x) AS x FROM c{r} c LEFT JOIN u{r} u USING (part, e))""")
    last = config.rounds
    steps.append(f"""o AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id)""")
    steps.append(f"""h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c{last})""")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, h"


def oracle_sql() -> dict[str, str]:
    return {"op11_vector_codes": vector_code_sql(), "op6_minhash_near_dedup": NEAR_SQL, "op8_exact_dedup": EXACT_SQL, "op9_line_dedup": LINE_SQL}
