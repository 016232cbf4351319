"""Registered queries of the training-data operators, over whole tables, and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm import embedding_dedup, html_text, language_id, line_dedup, merkle, mixing, packing, pii, quality, quality_votes, simhash, suffix_dedup, whitening
from linkloom.llm.common import table, word_count

TOKENIZER = "word_bpe_49k.json"
#: Key of the registered pseudonyms; a production run passes a secret of its own.
PSEUDONYM_KEY = "registered-query"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    placed = mixing.curriculum(docs, word_count(F.col("text")))
    return placed.select(
        "doc_id", "size", "source_size", "target", "taken", F.get("placements", F.lit(0))["position"].alias("position")
    ).orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    model = language_id.fit(docs.where(~held_out), "text", "lang", F.col("doc_id"))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PSEUDONYM_KEY).select("doc_id", "text", "n_found", "n_replaced")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judge(docs).drop("source", "host_rate")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("_fp", "_root")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    text = F.col("text")
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    altered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 0  # null: not altered
    tampered = F.when(altered, merkle.leaf_digest(*fields, merkle.lower_ascii(text)))
    made = merkle.manifest(
        docs, F.col("lang"), F.col("doc_id"), merkle.leaf_digest(*fields, text), {"doc_id": F.col("doc_id"), "tampered": tampered}
    )
    root = merkle.folded(F.coalesce("tampered", "leaf"), F.col("path"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), root.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality_votes.held_out(F.col("doc_id"), 4, 2)
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    made = quality_votes.vote(docs, quality_votes.fit(docs, labels), "text", threshold=0.7)
    return made.select("row.doc_id", "score", "predicted").withColumn("held_out", held_out)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mixing,
        op2_language_id,
        op3_suffix_dedup,
        op4_embedding_dedup,
        op5_packing,
        op6_pii,
        op7_html_text,
        op8_line_dedup,
        op9_quality,
        op10_simhash,
        op11_merkle,
        op12_whitening,
        op13_quality_votes,
        pipeline,
    )
}

#: RE2 classes of a word and of white space, as in the operators.
_WORD, _SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

_MIXING = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS spread
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM totals),
weighed AS (SELECT *, place % 3 + 1 AS weight, source_size * 3 AS cap, place % 3 AS slot FROM placed),
filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS left_tokens,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS left_weight,
         row_number() OVER (ORDER BY cap / weight, place) AS rank
  FROM weighed WINDOW o AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rank AS r, left_tokens AS t, left_weight AS w FROM filled
          WHERE weight * left_tokens <= cap * left_weight ORDER BY rank LIMIT 1),
targets AS (
  SELECT source, slot, source_size,
         CASE WHEN rank >= r THEN weight::DOUBLE * t::DOUBLE / w::DOUBLE ELSE cap::DOUBLE END AS target
  FROM filled, level),
started AS (
  SELECT s.*, t.slot, t.source_size, t.target, floor(t.target + 0.5)::BIGINT AS quota,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.spread, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
shares AS (
  SELECT *, greatest(0, least(size, quota - start)) AS w0, greatest(0, least(size, quota - start - source_size)) AS w1,
         greatest(0, least(size, quota - start - 2 * source_size)) AS w2,
         CASE WHEN quota > 0 THEN start::DOUBLE / quota::DOUBLE ELSE 0.0::DOUBLE END AS x
  FROM started)
SELECT doc_id, size, source_size, target, (w0 + w1 + w2)::BIGINT AS taken,
       CASE WHEN w0 <= 0 THEN NULL
            WHEN slot = 0 THEN 0.0::DOUBLE + 2.0::DOUBLE * x / 2.0::DOUBLE
            WHEN slot = 1 AND x < 0.375::DOUBLE THEN 2.0::DOUBLE * x / (0.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 0.25::DOUBLE + 2.0::DOUBLE * x)))
            WHEN slot = 1 THEN 0.5::DOUBLE + 2.0::DOUBLE * (x - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE + 2.0::DOUBLE * (x - 0.375::DOUBLE))))
            ELSE 2.0::DOUBLE * x / (1.5::DOUBLE + sqrt(greatest(0.0::DOUBLE, 2.25::DOUBLE - 2.0::DOUBLE * x))) END AS position
FROM shares
"""

_LINES = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k AS ck, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT keyed.*, last IS NOT NULL AND doc_id <> last AS dropped FROM keyed LEFT JOIN common ON k = ck)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

_QUALITY = rf"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '{_WORD}')),
same AS (SELECT doc_id, count(*) AS n_text_lines, count(*) - count(DISTINCT line) AS dup FROM lines GROUP BY doc_id),
measured AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(body, '{_SPACE}', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(body, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(n_text_lines, 0) AS n_text_lines
  FROM words LEFT JOIN repeated USING (doc_id) LEFT JOIN same USING (doc_id)),
failed AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, 10 * n_symbols > word_chars AS f3,
         10 * n_dup_lines > 3 * n_text_lines AS f4 FROM measured),
hosts AS (
  SELECT source, count(*) AS n, count(*) FILTER (f1) AS c1, count(*) FILTER (f2) AS c2, count(*) FILTER (f3) AS c3,
         count(*) FILTER (f4) AS c4 FROM failed GROUP BY source),
long AS (SELECT source, n, unnest([c1, c2, c3, c4]) AS c, unnest([1, 2, 3, 4]) AS rule FROM hosts),
moments AS (SELECT rule, avg(c / n) AS m, coalesce(var_samp(c / n), 0) AS v FROM long GROUP BY rule),
prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN least(1e6, greatest(1e-3, m * (1 - m) / v - 1)) ELSE 1e6 END AS k FROM moments),
verdicts AS (SELECT source, max((c + m * k) / (n + k)) <= 0.5 AS ok FROM long JOIN prior USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (f1 OR f2) AS base_failed,
       (NOT (f1 OR f2) AND ok) AS kept
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""


def _merkle_sql(leaf_levels: int = 12, tree_levels: int = 6) -> str:
    """Levels one by one: a tree of one node is passed on as it is. Holds for 8^12 rows a language, 8^6 languages."""
    upper, lower = merkle.UPPER, merkle.LOWER
    value = lambda text: f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"
    fields = " || ".join(value(f"{c}::VARCHAR") for c in ("doc_id", "source", "lang", "n_chars"))

    def levels(name: str, bottom: str, count: int) -> str:
        steps = [f"{name}_0 AS MATERIALIZED ({bottom})"]
        for k in range(1, count + 1):
            steps.append(
                f"{name}_{k} AS MATERIALIZED (SELECT tree, place // 8 AS place, (max(size) + 7) // 8 AS size,"
                f" CASE WHEN max(size) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY place)) END AS h"
                f" FROM {name}_{k - 1} GROUP BY tree, place // 8)"
            )
        for k in range(count):
            own = "OVER (PARTITION BY tree, place // 8 ORDER BY place ROWS BETWEEN"
            steps.append(
                f"{name}_way_{k} AS MATERIALIZED (SELECT tree AS t, place AS p, size > 1 AS up,"
                f" coalesce(string_agg(h, '') {own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,"
                f" coalesce(string_agg(h, '') {own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}_{k})"
            )
        return ",\n".join(steps)

    def climb(name: str, source: str, count: int, tree: str, place: str) -> str:
        steps = []
        for k in range(count):
            before = source if k == 0 else f"{name}_climb_{k - 1}"
            steps.append(
                f"{name}_climb_{k} AS (SELECT b.* REPLACE (CASE WHEN up THEN sha256(l || b.fold || r) ELSE b.fold END AS fold,"
                f" b.proof || CASE WHEN up THEN l || r ELSE '' END AS proof)"
                f" FROM {before} b JOIN {name}_way_{k} ON t = b.{tree} AND p = b.{place} // {8**k})"
            )
        return ",\n".join(steps)

    return f"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS crc FROM (
    SELECT n, list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
leaves AS (
  SELECT doc_id, lang, sha256({fields} || {value("text")}) AS leaf,
         sha256({fields} || {value(f"translate(text, '{upper}', '{lower}')")}) AS altered,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                         lambda c, d: xor(c // 256, crc[xor(c, d) % 256 + 1])), 4294967295) AS checksum
  FROM documents, crc_table),
placed AS MATERIALIZED (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size,
         CASE WHEN checksum % 3 = 0 THEN altered ELSE leaf END AS fold, '' AS proof
  FROM leaves),
{levels("leaf", "SELECT tree, place, size, leaf AS h FROM placed", leaf_levels)},
{levels("tree", f"SELECT 0 AS tree, tree AS place, count(*) OVER () AS size, h FROM leaf_{leaf_levels}", tree_levels)},
{climb("leaf", "placed", leaf_levels, "tree", "place")},
langs AS (SELECT *, 0 AS one FROM leaf_climb_{leaf_levels - 1}),
{climb("tree", "langs", tree_levels, "one", "tree")}
SELECT doc_id, leaf, s.h AS subroot, root.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root.h AS verified
FROM tree_climb_{tree_levels - 1} d JOIN leaf_{leaf_levels} s ON s.tree = d.tree, tree_{tree_levels} root
"""


LLM_SQL: dict[str, str] = {"op1_mixing": _MIXING, "op8_line_dedup": _LINES, "op9_quality": _QUALITY, "op11_merkle": _merkle_sql()}
