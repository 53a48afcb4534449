"""The queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, imatch, importance, line_dedup, mixing, packing, piece_codec, quality, secret_scan, simhash, toxicity, url_filter, vector_codes
from ._common import read_table


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """From toxic rows and documents that aren't held out."""
    labels = read_table(spark, sf_dir, "labels").filter(~toxicity.held_out())
    return toxicity.train(docs, labels, docs.filter(~toxicity.held_out()))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = toxicity.score_documents(docs, toxicity_model(spark, docs, sf_dir))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The rules of the contract.
RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"), RULES, url_filter.seeded_model(spark))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(read_table(spark, sf_dir, "documents"))
    return out.withColumn("keep", F.col("score") >= 0.5)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(read_table(spark, sf_dir, "documents"))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edit_study(read_table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = piece_codec.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(read_table(spark, sf_dir, "documents"), simhash.Params(words=4, bits=64, radius=4))
    return out.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.find_secrets(read_table(spark, sf_dir, "documents"), secret_scan.train())
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "crf")
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = vector_codes.compress(read_table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_quality, op4_line_dedup, op5_exact_dedup, op6_imatch, op7_piece_codec, op8_simhash, op9_packing, op10_secret_scan, op11_vector_codes, op12_importance, op13_source_mix)}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), holders AS (
  SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT keyed.doc_id, line_no, line, keeper IS NOT NULL AND keeper <> keyed.doc_id AS dropped
  FROM keyed LEFT JOIN holders ON keyed.k = holders.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
        "op5_exact_dedup": """
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
            "op11_vector_codes": CODES_SQL,
        "op12_importance": IMPORTANCE_SQL,
        "op13_source_mix": MIX_SQL,
    }


def _round_sql(k: int) -> str:
    """The codebooks after one more round: floored means of the parts nearest to each entry."""
    distance = "list_sum(list_transform(list_zip(x.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    return f"""
near{k} AS (SELECT x.vec_id, x.p, min({distance} * 64 + b.e) % 64 AS e, min({distance} * 64 + b.e) // 64 AS d
  FROM parts x JOIN book{k} b ON x.p = b.p GROUP BY x.vec_id, x.p),
sums{k} AS (SELECT p, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
  SELECT near{k}.p, e, unnest(part) AS x, generate_subscripts(part, 1) AS i FROM near{k} JOIN parts USING (vec_id, p)) GROUP BY p, e, i),
mean{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS part FROM sums{k} GROUP BY p, e),
book{k + 1} AS (SELECT b.p, b.e, coalesce(m.part, b.part) AS part FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""


CODES_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS part FROM kept, range(16) r(p)
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 64
), book0 AS (
  SELECT p, e, part FROM first JOIN parts USING (vec_id)
), {_round_sql(0)}, {_round_sql(1)}, {_round_sql(2)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', e::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY vec_id
), labelled AS (
  SELECT label, sum(error)::BIGINT AS label_error FROM coded JOIN kept USING (vec_id) GROUP BY label
)
SELECT coded.vec_id, code, error, label_error,
       (SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) FROM (SELECT p, e, unnest(part)::VARCHAR AS x, generate_subscripts(part, 1) AS i FROM book2)) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id) JOIN labelled ON kept.label IS NOT DISTINCT FROM labelled.label"""

#: CRC-32 by its table of bytes, once for each distinct feature.
IMPORTANCE_SQL = """
WITH crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT range AS n FROM range(256))
), texts AS (
  SELECT 'd' AS of, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT of, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT of, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
), distinct_features AS (
  SELECT f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM (SELECT DISTINCT f FROM features)
), hashed AS (
  SELECT f, xor(list_reduce(list_concat([4294967295], bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM distinct_features, crc
), counted AS (
  SELECT of, id, bucket FROM features JOIN hashed USING (f)
), buckets AS (
  SELECT bucket, count(*) FILTER (WHERE of = 'd')::DOUBLE AS s, count(*) FILTER (WHERE of = 'b')::DOUBLE AS t FROM counted GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM buckets
), sums AS (
  SELECT id, count(*) AS n, sum(gain)::BIGINT AS g FROM counted JOIN gains USING (bucket) WHERE of = 'd' GROUP BY id
), scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0) AS weight
  FROM words LEFT JOIN sums USING (id) WHERE of = 'd'
), noisy AS (
  SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM noisy WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM noisy LEFT JOIN ranked USING (doc_id)"""

#: The sharing by its closed form, the thresholds by running sums over all documents in the order of their hash.
MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(sha256(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM sized GROUP BY source
), ordered AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS words, sum(weight) OVER () AS weights,
         coalesce(sum(2 * source_size) OVER held, 0)::DOUBLE AS most_before, coalesce(sum(weight) OVER held, 0) AS weight_before
  FROM sources WINDOW held AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT arg_min((words - most_before)::DOUBLE, source_size / weight) AS rest, arg_min(weights - weight_before, source_size / weight) AS free
  FROM ordered WHERE (2 * source_size)::DOUBLE * (weights - weight_before) >= (words - most_before)::DOUBLE * weight
), targets AS (
  SELECT source, source_size, CASE WHEN (2 * source_size)::DOUBLE * free < rest * weight THEN (2 * source_size)::DOUBLE ELSE rest * weight / free END AS target FROM sources, level
), running AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times,
         sum(size) OVER (PARTITION BY sized.source ORDER BY h)::BIGINT AS after, sum(size) OVER (PARTITION BY sized.source, h)::BIGINT AS own
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (times + CASE WHEN after <= target - times * source_size OR (after - own <= target - times * source_size
                                  AND target - times * source_size - (after - own) >= after - (target - times * source_size)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running"""
