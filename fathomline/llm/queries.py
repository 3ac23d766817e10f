"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
import public_tokenizers

from fathomline.llm import bpe, chat, decontamination, filter_audit, language, pii, quality, toxicity, warc
from fathomline.llm.embeddings import near_vectors
from fathomline.llm.exact import exact_duplicates
from fathomline.llm.minhash import near_duplicates
from fathomline.llm.phrases import collocations

VOCABULARY = "byte_bpe_multi_50k.tiktoken"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(doc_id.cast("string")) % folds


def ranks(spark: SparkSession, name: str = VOCABULARY):
    """The bytes of a vocabulary file, under a megabyte, for all executors."""
    with open(public_tokenizers.path(name), "rb") as file:
        return spark.sparkContext.broadcast(file.read())


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = bpe.round_trip(table(spark, sf_dir, "documents"), ranks(spark), public_tokenizers.PATTERN)
    return tokens.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 5) != 0)
    return toxicity.score(docs, model, "doc_id").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))

    def written(column: str) -> Column:
        each = F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(number, pii.KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans")
    )


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, lambda doc_id: fold(doc_id, 3) != 1)
    return language.predict(docs, model, "doc_id").select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), lambda doc_id: fold(doc_id, 5) != 0)
    return quality.score(docs, model, "doc_id").select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query
def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE["op1_embeddings"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x <> 0)) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
number AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(number.n, 0) AS n_links, coalesce(least(v.vec_id, least.b), v.vec_id) AS component_id,
  v.vec_id = coalesce(least(v.vec_id, least.b), v.vec_id) AS kept
FROM v LEFT JOIN least ON v.vec_id = least.a LEFT JOIN number ON v.vec_id = number.a
"""

ORACLE["op10_minhash"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] ELSE list_distinct(list_transform(
    range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) END AS shingles FROM w
), one AS (
  SELECT min(doc_id) AS doc_id, list_sort(shingles) AS shingles FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles)
), cls AS (
  SELECT s.doc_id, one.doc_id AS rep FROM s JOIN one ON list_sort(s.shingles) = one.shingles
), flat AS (SELECT doc_id, unnest(shingles) AS shingle FROM one),
size AS (SELECT doc_id, len(shingles) AS n FROM one),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id
  WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), reach AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles,
  coalesce(least(cls.rep, least.b), cls.rep, s.doc_id) AS component_id,
  s.doc_id = coalesce(least(cls.rep, least.b), cls.rep, s.doc_id) AS kept
FROM s LEFT JOIN cls ON s.doc_id = cls.doc_id LEFT JOIN least ON cls.rep = least.a
"""


@query
def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.parse(chat.render(chat.fold(chat.events_of_turns(turns))))
    written = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("messages").cast("long").alias("n_turns"),
        F.sha2(written, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE["op6_chat"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) AS plain,
    len(regexp_extract_all(role || chr(1) || text, '<s>|</s>|<<SYS>>|<</SYS>>|\\[INST\\]|\\[/INST\\]|\\\\')) AS escapes
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(plain + escapes + 22) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.look_up(warc.write(pages), pages).drop("payload")


ORACLE["op8_warc"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha256(coalesce(html, '')) AS digest FROM pages
), f AS (
  SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) END AS first FROM p
)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f
"""


@query
def op11_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents arrive in two batches; the first is the snapshot that the second is screened by."""
    docs = table(spark, sf_dir, "documents")
    batch = F.coalesce(fold(F.col("doc_id"), 2), F.lit(0))
    return exact_duplicates([docs.where(batch == k) for k in range(2)])


ORACLE["op11_exact"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  coalesce(doc_id = max(doc_id) OVER same, false) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query
def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE["op12_phrases"] = """
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM piece
), f AS (
  SELECT lang, m, array_to_string(words[i:i + m - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, words, m, unnest(range(1, len(words) - m + 2)) AS i FROM w, range(1, 6) t(m)) GROUP BY ALL
), total AS (
  SELECT lang, sum(a) AS n FROM f WHERE m = 1 GROUP BY lang
), cand AS (
  SELECT * FROM f WHERE m >= 2 AND a >= 100
), cut AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, k, (1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k, string_split(phrase, ' ') AS s FROM cand) c
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(s[1:k], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(s[k + 1:], ' ')
  JOIN total ON total.lang = c.lang
), weakest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inside AS (
  SELECT DISTINCT c.lang, c.phrase FROM cand c JOIN cand d ON c.lang = d.lang AND d.m > c.m
    AND 100 * d.a >= 100 * c.a AND contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ')
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM weakest WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM inside)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = filter_audit.failed_filters(table(spark, sf_dir, "documents"))
    labelled = filter_audit.with_labels(failed, table(spark, sf_dir, "labels"))
    return filter_audit.audit(labelled, filter_audit.FILTERS)


ORACLE["op13_filter_audit"] = """
WITH w AS (
  SELECT *, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, coalesce(max(quality) = 1, false) AS good, coalesce(max(toxic) = 1, false) AS toxic FROM labels GROUP BY doc_id
), flagged AS (
  SELECT coalesce(source, '') AS part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, concat(
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id
), cell AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM flagged GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
  SELECT filter_order, CAST(s AS INTEGER) AS step, filter_order[s] AS f, left(filter_order, s - 1) AS before
  FROM orders, range(1, 6) t(s)
), told AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS failed, fails = f AS alone,
    length(translate(before, fails, '')) = length(before) AS reached
  FROM cell, steps
), figures AS (
  SELECT part, filter_order, step, f,
    CAST(coalesce(sum(n) FILTER (reached AND NOT failed), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (reached AND failed), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (NOT reached AND failed), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(good) FILTER (reached AND failed), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(toxic) FILTER (reached AND failed), 0) AS BIGINT) AS toxic_lost
  FROM told GROUP BY ALL
)
SELECT * EXCLUDE (f), CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM figures
"""
