"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, audio, bpe, brown, langid, licences, mixing, neardup, passages, tokenfile
from .common import WORD, crc_mod, documents, new_path, word_count


def tokenizer_path() -> str:
    """The public tokenizer file; VEILGRID_TOKENIZER names another."""
    if own := os.environ.get("VEILGRID_TOKENIZER"):
        return own
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_token_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    tokenfile.write_tokens(documents(spark, sf_dir), tokenizer_path(), path)
    return tokenfile.read_tokens(spark, path, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audio.features(audio.store_media(documents(spark, sf_dir)))
    feature = F.concat_ws(";", F.concat(F.lit("frames="), F.col("n_frames")), F.concat(F.lit("segments="), F.size("segments")), F.concat(F.lit("tensors="), F.sha2("tensors", 256)))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    return documents(spark, sf_dir).withColumn("path", F.concat_ws("/", "source", part(1000), part(100), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_files(spark, sf_dir), word_count(F.col("text")) <= 60, ["doc_id"], lines_only=True)


def op3_licence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op3_licence_scan, from all lines, sentences, blocks and whole texts."""
    return licences.scan(_files(spark, sf_dir), word_count(F.col("text")) <= 60, ["doc_id"])


def op4_hyperdimensional_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", crc_mod(F.col("doc_id"), 5) == 0)
    return langid.identify(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op5_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5, query=F.col("vec_id") % 50 == 0)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = passages.remove_repeats(documents(spark, sf_dir), 400)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(documents(spark, sf_dir), tokenizer_path())
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_probminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def quality_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, weight: 2 for labelled good quality, 1/2 for bad."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return labels.filter("quality is not null").select("doc_id", F.when(F.col("quality") == 1, 2.0).otherwise(0.5).alias("weight"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.mix(sized, labels=quality_weights(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    return brown.score(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {f.__name__: f for f in (op1_token_grammar, op2_audio_features, op3_licence_scan, op3_licence_texts, op4_hyperdimensional_langid, op5_projection_forest, op6_suffix_dedup, op7_bpe_roundtrip, op8_probminhash_neardup, op9_source_mix, op10_brown_scores)}

_TEMPLATE_ROWS = ", ".join(f"('{k}', '{v}')" for k, v in licences.TEMPLATES.items())
_TEMPLATE_TEXTS = ", ".join(f"('{k}', {n}, '{' '.join(v)}')" for k, n, v in licences.template_terms())
_PATH = "concat_ws('/', source, CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), doc_id || '.txt')"

ORACLES = {
    "op3_licence_texts": f"""
WITH files AS (SELECT doc_id, text, {_PATH} AS path, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) <= 60 AS declares FROM documents),
texts AS (SELECT DISTINCT text AS body, md5(text) AS text FROM files WHERE text IS NOT NULL),
lines AS (SELECT text, unnest(string_split(body, chr(10))) AS body, generate_subscripts(string_split(body, chr(10)), 1) AS line FROM texts),
parts AS (SELECT text, line, NOT regexp_matches(lower(body), '[0-9a-z]') AS blank, string_split(regexp_replace(body, '{licences.STOP}', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM lines),
pieces AS (SELECT text, line, blank, len(parts) AS n, unnest(parts) AS piece, generate_subscripts(parts, 1) AS place FROM parts),
cut AS (SELECT text, line, piece,
               coalesce(sum(CAST(blank OR place < n OR regexp_matches(piece, '{licences.STOP_END}') AS INTEGER)) OVER w, 0) AS sentence, coalesce(sum(CAST(blank AS INTEGER)) OVER w, 0) AS block
        FROM pieces WINDOW w AS (PARTITION BY text ORDER BY line, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
words AS (SELECT text, line, sentence, block, unnest(regexp_extract_all(lower(piece), '{licences.TERM}')) AS term FROM cut),
templates AS (SELECT * FROM (VALUES {_TEMPLATE_TEXTS}) t(licence, form, words)),
tt AS (SELECT licence, form, term, count(*) AS tt FROM (SELECT licence, form, unnest(string_split(words, ' ')) AS term FROM templates) GROUP BY ALL),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT count(*) FROM templates)) / (1 + count(*))) + 1 AS idf FROM tt GROUP BY term),
y AS (SELECT licence, form, term, (1 + ln(tt)) * idf AS y FROM tt JOIN idf USING (term)),
ys AS (SELECT form, sqrt(sum(y * y)) AS ys, sum(y) AS total FROM y GROUP BY form),
units AS (SELECT text, unnest([{{'kind': 0, 'no': line}}, {{'kind': 1, 'no': sentence}}, {{'kind': 2, 'no': block}}, {{'kind': 3, 'no': 0}}]) AS unit, term, idf FROM words JOIN idf USING (term)),
x AS (SELECT text, unit, term, (1 + ln(count(*))) * any_value(idf) AS x FROM units GROUP BY text, unit, term),
xs AS (SELECT text, unit, sqrt(sum(x * x)) AS xs FROM x GROUP BY text, unit),
dots AS (SELECT text, unit, licence, form, sum(x * y) AS dot, sum(y) AS held FROM x JOIN y USING (term) GROUP BY ALL),
scored AS (SELECT text, licence, round(dot / (xs * ys), 6) AS score FROM dots JOIN xs USING (text, unit) JOIN ys USING (form) WHERE round(held / total, 6) >= {licences.SHARE}),
tags AS (SELECT text, unnest(regexp_extract_all(tag, '{licences.SPDX_ID}')) AS id FROM (SELECT text, unnest(regexp_extract_all(body, '{licences.SPDX}', 1)) AS tag FROM texts)),
found AS (SELECT text, licence, score FROM scored WHERE score >= 0.6
          UNION SELECT text, regexp_replace(id, '{licences.SPDX_TAIL}', ''), 1.0 FROM tags WHERE NOT regexp_matches(id, '{licences.SPDX_NONE}')),
own AS (SELECT text, licence, score FROM found QUALIFY row_number() OVER (PARTITION BY text ORDER BY licence = 'Proprietary', score DESC, licence) = 1),
r AS (SELECT f.doc_id, f.path, declares, licence, score, regexp_replace(f.path, '/?[^/]*$', '') AS folder FROM files f LEFT JOIN own ON md5(f.text) = own.text),
declared AS (SELECT folder AS above, arg_min(licence, struct_pack(path := path, licence := licence)) AS declared FROM r WHERE declares AND licence IS NOT NULL GROUP BY folder),
up AS (SELECT folder, unnest(generate_series(0, len(string_split(folder, '/')))) AS distance FROM (SELECT DISTINCT folder FROM r)),
near AS (SELECT folder, declared, distance FROM (SELECT folder, distance, array_to_string(string_split(folder, '/')[1:greatest(0, len(string_split(folder, '/')) - distance)], '/') AS above FROM up) JOIN declared USING (above)
         QUALIFY row_number() OVER (PARTITION BY folder ORDER BY distance) = 1)
SELECT doc_id, path, licence AS own_licence, score, coalesce(licence, declared) AS licence,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN declared IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CAST(CASE WHEN licence IS NULL AND declared IS NOT NULL THEN distance END AS INTEGER) AS distance
FROM r LEFT JOIN near USING (folder)""",
    "op3_licence_scan": f"""
WITH files AS (
  SELECT doc_id, text, concat_ws('/', source, CAST(CAST(floor(doc_id / 1000) AS BIGINT) AS VARCHAR), CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR), doc_id || '.txt') AS path,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0) <= 60 AS declares FROM documents),
lines AS (SELECT doc_id, path, line FROM (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS line FROM files) WHERE regexp_matches(line, '{licences.TRIGGER}')),
kinds AS (SELECT line, count(*) AS n FROM lines GROUP BY line),
total AS (SELECT coalesce(sum(n), 0) AS total FROM kinds),
tf AS (SELECT line, n, term, count(*) AS tf FROM (SELECT line, n, unnest(regexp_extract_all(lower(line), '{licences.TERM}')) AS term FROM kinds) GROUP BY ALL),
df AS (SELECT term, sum(n) AS df FROM tf GROUP BY term),
tt AS (SELECT licence, term, count(*) AS tt FROM (SELECT licence, unnest(string_split(words, ' ')) AS term FROM (VALUES {_TEMPLATE_ROWS}) t(licence, words)) GROUP BY ALL),
x AS (SELECT line, term, tf * (ln((1.0 + total) / (1 + df)) + 1) AS x FROM tf JOIN df USING (term), total),
y AS (SELECT licence, term, tt * (ln((1.0 + total) / (1 + coalesce(df, 0))) + 1) AS y FROM tt LEFT JOIN df USING (term), total),
xs AS (SELECT line, sqrt(sum(x * x)) AS xs FROM x GROUP BY line),
ys AS (SELECT licence, sqrt(sum(y * y)) AS ys FROM y GROUP BY licence),
dots AS (SELECT line, licence, sum(x * y) AS dot FROM x JOIN y USING (term) GROUP BY ALL),
scored AS (SELECT line, licence, round(dot / (xs * ys), 6) AS score FROM dots JOIN xs USING (line) JOIN ys USING (licence)),
best AS (SELECT line, licence, score FROM scored WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, licence) = 1),
own AS (SELECT DISTINCT doc_id, licence, score FROM lines JOIN best USING (line) QUALIFY dense_rank() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
r AS (SELECT f.doc_id, f.path, declares, licence, score, regexp_replace(f.path, '/?[^/]*$', '') AS folder FROM files f LEFT JOIN own USING (doc_id)),
declared AS (SELECT folder AS above, arg_min(licence, struct_pack(path := path, licence := licence)) AS declared FROM r WHERE declares AND licence IS NOT NULL GROUP BY folder),
up AS (SELECT folder, unnest(generate_series(0, len(string_split(folder, '/')))) AS distance FROM (SELECT DISTINCT folder FROM r)),
near AS (SELECT folder, declared, distance FROM (SELECT folder, distance, array_to_string(string_split(folder, '/')[1:greatest(0, len(string_split(folder, '/')) - distance)], '/') AS above FROM up) JOIN declared USING (above)
         QUALIFY row_number() OVER (PARTITION BY folder ORDER BY distance) = 1)
SELECT doc_id, path, licence AS own_licence, score, coalesce(licence, declared) AS licence,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN declared IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CAST(CASE WHEN licence IS NULL AND declared IS NOT NULL THEN distance END AS INTEGER) AS distance
FROM r LEFT JOIN near USING (folder)""",
    "op9_source_mix": f"""
WITH quality AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
r AS (
  SELECT d.doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         -ln((CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)
         / CASE WHEN q IS NULL THEN 1.0 WHEN q = 1 THEN 2.0 ELSE 0.5 END AS key
  FROM documents d LEFT JOIN quality USING (doc_id)),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most FROM s),
f AS (SELECT *, row_number() OVER o AS place,
             ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW o AS (ORDER BY most / w, source IS NULL, source)),
water AS (SELECT arg_min(level, place) AS water FROM f WHERE level <= most / w),
t AS (SELECT source, source_size, least(most, coalesce(water * w, most)) AS target FROM f, water),
p AS (SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS epochs FROM t),
k AS (SELECT r.doc_id, r.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
             sum(r.size) OVER (PARTITION BY r.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - r.size / 2 AS middle
      FROM r JOIN p ON r.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN budget > 0 AND middle <= budget THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k""",
}
