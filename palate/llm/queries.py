"""The queries of this subpackage: each applies one operator to its whole table and derives the columns of its result."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_text, langid, line_dedup, mixing, packing, periodic, quality, resample, simhash, topk, toxicity, url_filter
from .common import read_table, words


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """The content of an installed public tokenizer file, read once on the driver and sent to the executors."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = vocabulary()
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode_and_decode(docs, spec)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: null)."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(n))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    dictionaries = langid.learn(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", "text", held_out.alias("held_out")), dictionaries).select("doc_id", "held_out", "lang_pred", "score", "rejected")


#: Domains of the labelled table: texts of low quality, and the languages of the others; and the weights wanted for their tokens.
MIX_TARGETS = {"de": 0.16, "en": 0.54, "es": 0.12, "fr": 0.15, "low": 0.03}


def labelled_domains(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents."""
    labels = read_table(spark, sf_dir, "labels").filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q"))
    return docs.select("doc_id", "lang").join(labels, "doc_id").select("doc_id", F.when(F.col("q") == 0, "low").otherwise(F.col("lang")).alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return mixing.mix(docs.select("doc_id", "text"), labelled_domains(spark, sf_dir, docs), MIX_TARGETS).select("doc_id", "n_words", "posterior", "rate", "copies")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    machine = toxicity.learn(docs, read_table(spark, sf_dir, "labels").filter(~held_out))
    scored = toxicity.score(docs.withColumn("held_out", held_out), machine)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.to_integers(read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "vector")
    return topk.top_k(vectors, vectors.filter(F.col("id") % 20 == 0))


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "benchmark")
    return resample.draw(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """The contract's texts: in a tenth of the documents, by hash of the id, the words from a on repeat with a period p."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    g = F.floor(h / 10)

    def again(w: Column) -> Column:  # w: the words, split once, as a variable of the outer lambda
        a = g % F.size(w)
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        return F.array_join(F.transform(w, lambda x, i: F.when(i >= a, F.get(w, (a + (i - a) % p).cast("int"))).otherwise(x)), " ")

    planted = F.transform(F.array(words(F.col("text"))), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(""))
    return docs.select("doc_id", F.explode(F.when(h % 10 == 0, planted).otherwise(F.array("text"))).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_planted_runs(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.collapse_runs(docs)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.array_join(F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"])), "")
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"), F.sha2(told, 256).alias("runs_sha256"))
    start, length, period = -F.col("best.start"), F.col("best.length"), -F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), with_ids=False)


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
shared AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, owner IS NOT NULL AND owner <> doc_id AS lost FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Floors are computed in double, as Spark does; DuckDB keeps the products exact in 128 bits.
OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

QUERIES = {f.__name__: f for f in (op1_bpe, op2_simhash, op3_html_text, op4_url_filter, op5_language, op6_mixing, op7_toxicity, op8_line_dedup, op9_quality, op10_topk, op11_resample, op12_periodic_runs, op13_packing)}
#: crc32 by its table of 256 remainders, a byte at a time.
OP11_SQL = """
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (
  SELECT 'd' AS side, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
features AS (
  SELECT side, id, f, count(*) AS n FROM (
    SELECT side, id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts)
  GROUP BY ALL),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode(f))), lambda i: (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1)),
                        lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f, hex(encode(f)) AS x FROM features), crc),
counted AS (SELECT side, id, bucket, sum(n) AS n FROM features JOIN hashed USING (f) GROUP BY ALL),
buckets AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0) AS t FROM counted GROUP BY bucket),
sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM buckets),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM buckets, sums),
weighed AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(CAST(sum(n * gain) AS DOUBLE) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight FROM counted JOIN gains USING (bucket) WHERE side = 'd' GROUP BY id),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(sha256('7:' || id), i, 1)) - 1)), lambda a, b: a * 16 + b) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM texts LEFT JOIN weighed USING (id) WHERE side = 'd'),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""

ORACLE_SQL = {"op8_line_dedup": OP8_SQL, "op10_topk": OP10_SQL, "op11_resample": OP11_SQL}
