"""The ``opN_<name>`` queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.token_counts import count_tokens

    docs = documents(spark, sf_dir).select("doc_id", "text")
    docs = docs.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    counted = count_tokens(docs, _vocabulary("byte_bpe_50k.json"), keep=["doc_id", "n_bytes"])
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.bpe import decode, encode

    path = _vocabulary("word_bpe_49k.json")
    ids = encode(documents(spark, sf_dir).select("doc_id", "text"), path, keep=["doc_id"])
    both = decode(ids, path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.warc import derivatives, responses

    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet"), "2024-01-01T00:00:00Z"))
    return made.select(F.col("key").alias("page_id"), "warc_type", "record_id", "refers_to", "content_length", "block_digest", F.sha2("record", 256).alias("record_sha256"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.pii import KINDS, personal_data

    found = personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    kinds = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")

    ordered = F.array_sort(F.concat("base", "found"), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["kind"] - b["kind"])).cast("int"))
    by_kind = F.array_sort(F.col("base"), lambda a, b: F.when(a["start"] != b["start"], F.signum(a["start"] - b["start"])).otherwise(F.signum(a["kind"] - b["kind"])).cast("int"))

    def of_kind(k):  # a default argument would be taken for the element's index
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(by_kind), 256).alias("base_sha256"), joined(ordered).alias("spans"), F.size("found").cast("long").alias("n_found"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.chat import conversation_digests, prefix_targets

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", says), (-7, 1, "assistant", says)], "conv_id long, turn long, role string, text string")
    return conversation_digests(prefix_targets(turns.unionByName(more)))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.near_dedup import near_duplicates

    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.fingerprint import as_text, fingerprint, likeness, with_next

    docs = with_next(documents(spark, sf_dir).select("doc_id", "text"))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    docs = docs.withColumn("edited", edited)
    docs = docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("text")).alias("own"),
        fingerprint(F.col("edited")).alias("new"),
        fingerprint(F.col("next_text")).alias("next"),
    )
    return docs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("new")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )


def _fold(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string")) % 3


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.language import predict, train

    docs = documents(spark, sf_dir)
    field = train(docs.where(_fold() != 1).select("doc_id", "text", "lang"))
    held = docs.select("doc_id", "text", F.coalesce(_fold() == 1, F.lit(False)).alias("held_out"))
    return predict(held, field, keep=["doc_id", "held_out"])


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.quality import quality_rules

    return quality_rules(documents(spark, sf_dir).select("doc_id", "text", "lang"), keep=["doc_id"])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.mixing import mix

    return mix(documents(spark, sf_dir).select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.resampling import resample

    return resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.divergence import divergence

    return divergence(documents(spark, sf_dir).select("text", "lang", "source"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from driftwood.llm.vectors import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe": op2_bpe,
    "op3_warc": op3_warc,
    "op4_pii": op4_pii,
    "op5_chat": op5_chat,
    "op6_near_dedup": op6_near_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_language": op8_language,
    "op9_quality": op9_quality,
    "op10_mixing": op10_mixing,
    "op11_resampling": op11_resampling,
    "op12_divergence": op12_divergence,
    "op13_near_vectors": op13_near_vectors,
}

ORACLE_SQL: dict[str, str] = {
    "op10_mixing": r"""
WITH base AS (
  SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM sizes),
filling AS (
  SELECT *, 2.0::DOUBLE * source_size / weight AS full_at,
         coalesce(sum(source_size) OVER w, 0) * 2 AS full_before, coalesce(sum(weight) OVER w, 0) AS weight_before,
         sum(source_size) OVER () AS all_words, sum(weight) OVER () AS all_weight
  FROM weighed
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
  SELECT *, (all_words::DOUBLE * 1.5::DOUBLE - full_before::DOUBLE) / (all_weight - weight_before)::DOUBLE AS level FROM filling),
goals AS (
  SELECT source, source_size,
         coalesce(least((SELECT max(level) FROM levels WHERE level <= full_at) * weight, 2.0::DOUBLE * source_size), 2.0::DOUBLE * source_size) AS target
  FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM goals),
hashes AS (
  SELECT source, h, n, coalesce(sum(n) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT source, h, sum(size) AS n FROM base GROUP BY source, h)),
edges AS (
  SELECT p.source, max(x.h) AS edge, arg_max(x.n, x.h) AS n, arg_max(x.before, x.h) AS before
  FROM parts p JOIN hashes x ON p.source IS NOT DISTINCT FROM x.source
  WHERE x.before <= p.target - p.whole * p.source_size GROUP BY p.source)
SELECT b.doc_id, b.size, p.source_size, p.target,
       (b.size * least(2, p.whole + CASE WHEN b.h < e.edge OR (b.h = e.edge AND e.n < 2 * (p.target - p.whole * p.source_size - e.before)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM base b JOIN parts p ON b.source IS NOT DISTINCT FROM p.source LEFT JOIN edges e ON b.source IS NOT DISTINCT FROM e.source
""",
    # crc32 is summed up byte by byte: the table of 256 remainders, then a fold over each word
    "op11_resampling": r"""
WITH table_ AS (
  SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384::BIGINT, c // 2) ELSE c // 2 END) ORDER BY b) AS t
  FROM range(256) r(b)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
own AS (SELECT doc_id, unnest(words) AS word FROM docs),
aim AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM benchmark),
bytes AS (
  SELECT word, list_transform(range(strlen(word)), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT) AS b
  FROM (SELECT word FROM own UNION SELECT word FROM aim)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256)), 4294967295::BIGINT) % 10000 AS bucket
  FROM bytes, table_),
source AS (SELECT bucket, count(*) AS n FROM own JOIN hashed USING (word) GROUP BY bucket),
goal AS (SELECT bucket, count(*) AS n FROM aim JOIN hashed USING (word) GROUP BY bucket),
gains AS (
  SELECT s.bucket, floor(1000 * ln((coalesce(g.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM source) + 10000)::DOUBLE
         / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM goal), 0) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM source s LEFT JOIN goal g USING (bucket)),
weights AS (
  SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
         (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (doc_id)),
ranked AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place,
         count(*) FILTER (WHERE n_features >= 20) OVER () * 10 // 100 AS size
  FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= size THEN place END::BIGINT AS rank FROM ranked
""",
    "op12_divergence": r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
each AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term FROM each GROUP BY lang, term HAVING count(DISTINCT d) >= 30),
occurring AS (SELECT lang, source, term, count(*) AS n FROM each SEMI JOIN kept USING (lang, term) GROUP BY ALL),
own AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grid AS (
  SELECT o.lang, o.source, k.term, coalesce(c.n, 0)::HUGEINT AS n
  FROM own o JOIN kept k USING (lang) LEFT JOIN occurring c ON c.lang = o.lang AND c.source = o.source AND c.term = k.term),
shares AS (
  SELECT lang, source, term, n, (1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source)::HUGEINT + 5 * v))::BIGINT AS p
  FROM grid JOIN sizes USING (lang)),
whole AS (
  SELECT lang, term, (1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang)::HUGEINT + 5 * v))::BIGINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM grid GROUP BY lang, term) JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce((
           SELECT sum(abs(x.p - y.p)) FROM shares x JOIN shares y ON x.term = y.term
           WHERE x.lang = a.lang AND x.source = a.source AND y.lang = b.lang AND y.source = b.source), 0)::BIGINT AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.source <> b.source),
candidates AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER FROM candidates)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op13_near_vectors": r"""
WITH RECURSIVE rows_ AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
able AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM rows_
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND coalesce(list_sum(list_transform(v, lambda x: x * x)), 0) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
  WHERE list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2])) >= 0.93),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, coalesce(low, vec_id) >= vec_id AS kept
FROM rows_ LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) ON a = vec_id
LEFT JOIN (SELECT a AS o, min(b) AS low FROM reach GROUP BY a) ON o = vec_id
""",
}
