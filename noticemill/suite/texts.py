"""TF-IDF, near-duplicates, classification, and the curate summary."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticemill.functions.hashing import content_hash, record_id
from noticemill.functions.stopwords import ENGLISH
from noticemill.functions.text import document_text
from noticemill.operators.approximate import find_duplicates_approximately
from noticemill.operators.classify import load_or_train, predict, save, score, train, train_from_seed
from noticemill.operators.clusters import duplicate_clusters
from noticemill.operators.similarity import corpus, find_duplicates
from noticemill.operators.tfidf import CLASSIFIER_TERMS, postings, term_stats, vocabulary, weights
from noticemill.plans.curate import curate
from noticemill.schemas import CANONICAL
from noticemill.session import scratch_path, written
from noticemill.suite import views as v


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(v.document_records(spark, sf), "doc_id")


CORPUS = f"""{v.DOCUMENT_RECORDS},
corpus AS (
  SELECT doc_id AS id,
    regexp_replace(title || ' ' || description, '^\\s+|\\s+$', '', 'g') AS text
  FROM document_records
)"""
POSTINGS = f"""{CORPUS},
stop_words(word) AS (VALUES {v.values_list(ENGLISH)}),
tokens AS (
  SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM corpus
),
postings AS (
  SELECT id, term, count(*) AS tf FROM tokens
  WHERE term NOT IN (SELECT word FROM stop_words) GROUP BY id, term
)"""
VOCABULARY = f"""{POSTINGS},
vocabulary AS (
  SELECT *, row_number() OVER (ORDER BY df DESC, term) - 1 AS rank FROM (
    SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM postings GROUP BY term
    ORDER BY cf DESC, term LIMIT 10000)
)"""
WEIGHTS = f"""{VOCABULARY},
scaled AS (
  SELECT id, term, rank, tf,
    tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1.0::DOUBLE + df)) + 1) AS x
  FROM postings JOIN vocabulary USING (term)
),
weights AS (
  SELECT id, term, rank, tf, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM scaled
)"""
# every pair of documents that shares a term, in plain SQL
PAIRS = f"""{WEIGHTS},
doc_pairs AS (
  SELECT a.id AS id_a, b.id AS id_b, sum(a.weight * b.weight) AS similarity
  FROM weights a JOIN weights b ON a.term = b.term AND a.id < b.id
  GROUP BY a.id, b.id HAVING sum(a.weight * b.weight) >= 0.85
),
shapes AS (
  SELECT id, string_agg(rank || ':' || (tf / least)::VARCHAR, ' ' ORDER BY rank) AS shape
  FROM (SELECT *, min(tf) OVER (PARTITION BY id) AS least FROM weights) GROUP BY id
),
members AS (
  SELECT id, min(id) OVER (PARTITION BY shape) AS profile, count(*) OVER (PARTITION BY shape) AS n
  FROM shapes
)"""


def document_texts(spark: SparkSession, sf: str) -> DataFrame:
    return v.document_records(spark, sf).select("doc_id", document_text().alias("text"))


DOCUMENT_TEXTS = f"WITH {CORPUS} SELECT id AS doc_id, text FROM corpus"


def terms(spark: SparkSession, sf: str) -> DataFrame:
    return term_stats(postings(_corpus(spark, sf)))


TERMS = f"""WITH {POSTINGS}
SELECT term, sum(tf)::BIGINT AS cf, count(*) AS df FROM postings GROUP BY term"""


def vocabulary_top(spark: SparkSession, sf: str) -> DataFrame:
    return vocabulary(postings(_corpus(spark, sf))).select("term", "cf", "df", "rank")


VOCABULARY_TOP = f"WITH {VOCABULARY} SELECT term, cf, df, rank FROM vocabulary"


def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    weighted = weights(_corpus(spark, sf))
    return weighted.select("id", "term", F.round("weight", 6).alias("weight"))


TFIDF_WEIGHTS = f"WITH {WEIGHTS} SELECT id, term, round(weight, 6) AS weight FROM weights"


def _duplicates(spark: SparkSession, sf: str):
    return find_duplicates(v.document_records(spark, sf), "doc_id")


def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return _duplicates(spark, sf).pairs.withColumn("similarity", F.round("similarity", 6))


NEAR_DUPLICATES = f"""WITH {PAIRS}
SELECT id_a, id_b, round(similarity, 6) AS similarity, a.n AS n_a, b.n AS n_b
FROM doc_pairs JOIN members a ON id_a = a.id JOIN members b ON id_b = b.id
WHERE a.id = a.profile AND b.id = b.profile"""


def near_duplicates_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The same with limits so small that lists are cut into chunks and listed by two terms."""
    found = find_duplicates(v.document_records(spark, sf), "doc_id", chunk=4, long_list=12)
    return found.pairs.withColumn("similarity", F.round("similarity", 6))


def duplicate_copies(spark: SparkSession, sf: str) -> DataFrame:
    return _duplicates(spark, sf).copies()


DUPLICATE_COPIES = f"""WITH {PAIRS}
SELECT id, profile AS copy_of, n FROM members WHERE id <> profile"""


def near_duplicate_count(spark: SparkSession, sf: str) -> DataFrame:
    return _duplicates(spark, sf).pair_count()


NEAR_DUPLICATE_COUNT = f"WITH {PAIRS} SELECT count(*) AS n_pairs FROM doc_pairs"


def partner_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _duplicates(spark, sf).partner_counts()


PARTNER_COUNTS = f"""WITH {PAIRS}
SELECT id, count(*) AS n_partners
FROM (SELECT id_a AS id FROM doc_pairs UNION ALL SELECT id_b FROM doc_pairs) GROUP BY id"""


def partners(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicates of every document whose id is divisible by 50, written out."""
    asked = v.table(spark, sf, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("id"))
    found = _duplicates(spark, sf).partners_of(asked)
    return found.withColumn("similarity", F.round("similarity", 6))


PARTNERS = f"""WITH {PAIRS},
both_ways AS (
  SELECT id_a AS id, id_b AS partner, similarity FROM doc_pairs
  UNION ALL SELECT id_b, id_a, similarity FROM doc_pairs
)
SELECT id, partner, round(similarity, 6) AS similarity FROM both_ways
WHERE id % 50 = 0"""


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The cluster of every document; its longest text stays."""
    documents = v.document_records(spark, sf)
    return duplicate_clusters(_duplicates(spark, sf), documents, "doc_id", (-F.length(document_text()),))


CLUSTERS = f"""WITH RECURSIVE {PAIRS},
linked AS (
  SELECT id_a AS a, id_b AS b FROM doc_pairs UNION ALL SELECT id_b, id_a FROM doc_pairs
),
reach AS (
  SELECT id, id AS other FROM corpus
  UNION
  SELECT reach.id, b FROM reach JOIN linked ON reach.other = a
),
clustered AS (SELECT id, min(other) AS cluster_id FROM reach GROUP BY id)
SELECT id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS n,
  id = first_value(id) OVER (PARTITION BY cluster_id ORDER BY length(text) DESC, id) AS survivor
FROM clustered JOIN corpus USING (id)"""


def approximate_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """The pairs that signed random projections find; what may be missing are pairs near the threshold."""
    found = find_duplicates_approximately(v.document_records(spark, sf), "doc_id")
    return found.pairs.withColumn("similarity", F.round("similarity", 6))


def _raw_documents(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.document_records(spark, sf)
    return rows.select(
        "source_id",
        "source_name",
        F.concat(F.lit("doc:"), "source_id").alias("source_url"),
        F.lit(v.NOW).cast("timestamp").alias("fetched_at"),
        F.lit(None).cast("string").alias("raw_html"),
        F.create_map(F.lit("title"), "title", F.lit("description"), "description").alias(
            "extracted"
        ),
    ).withColumn("content_hash", content_hash("extracted"))


def process_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Documents curated into a table that already holds half of the languages."""
    raw = _raw_documents(spark, sf)
    stored = raw.filter(F.col("extracted")["title"].isin("Document en", "Document fr")).select(
        record_id("source_name", "source_id").alias("record_id"),
        "content_hash",
        F.lit(1).alias("version"),
        F.lit(v.NOW).cast("timestamp").alias("created_at"),
    )
    # a summary counts and compares; nothing of it asks for the model
    done = curate(raw, stored, None, now=F.lit(v.NOW).cast("timestamp"))
    return replace(done, normal=written(done.normal, "normal")).summary()


PROCESS_SUMMARY = f"""WITH {PAIRS}
SELECT (SELECT count(*) FROM documents) AS processed,
  (SELECT count(*) FROM documents WHERE lang NOT IN ('en', 'fr')) AS upserted,
  (SELECT count(*) FROM doc_pairs) AS duplicates_flagged"""


def curated_records(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical rows a first run over the documents writes, without the model's columns."""
    empty = spark.createDataFrame([], CANONICAL)
    done = curate(
        _raw_documents(spark, sf), empty, train_from_seed(spark), now=F.lit(v.NOW).cast("timestamp")
    )
    return done.changes().select(
        "record_id", "source_name", "source_id", "title",
        F.length("description").alias("n_chars"), "status", "currency", "version",
        F.col("category_confidence").between(0, 1).alias("confidence_ok"),
    )


CURATED_RECORDS = f"""WITH {v.DOCUMENT_RECORDS}
SELECT sha256(source_name || ':' || source_id) AS record_id, source_name, source_id, title,
  length(description) AS n_chars, {v.STATUS_SQL} AS status, 'USD' AS currency,
  1::INTEGER AS version, TRUE AS confidence_ok
FROM (SELECT *, lower(title || ' ' || description) AS t FROM document_records)"""

# A small fixed linear model over words of the documents.
MODEL = (
    ("construction", "the", 1.5),
    ("construction", "and", 1.0),
    ("supplies", "les", 2.0),
    ("supplies", "que", 1.0),
    ("consulting", "der", 2.0),
    ("consulting", "und", 1.5),
    ("healthcare", "los", 2.5),
    ("healthcare", "del", 1.0),
    ("unlisted", "document", 3.0),
)
INTERCEPTS = (
    ("construction", 0.1),
    ("supplies", 0.2),
    ("consulting", 0.0),
    ("healthcare", -0.1),
    ("unlisted", -0.5),
)


def classify_score(spark: SparkSession, sf: str) -> DataFrame:
    documents = _corpus(spark, sf)
    scored = score(
        documents,
        weights(documents, 5000, stop_words=()),
        spark.createDataFrame(list(MODEL), "class string, term string, coef double"),
        spark.createDataFrame(list(INTERCEPTS), "class string, intercept double"),
    )
    return scored.select("id", "category", F.round("category_confidence", 6).alias("confidence"))


_MODEL_ROWS = ", ".join(f"('{c}', '{t}', {w}::DOUBLE)" for c, t, w in MODEL)
_INTERCEPT_ROWS = ", ".join(f"('{c}', {w}::DOUBLE)" for c, w in INTERCEPTS)
CLASSIFY_SCORE = f"""WITH {CORPUS},
model(class, term, coef) AS (VALUES {_MODEL_ROWS}),
intercepts(class, intercept) AS (VALUES {_INTERCEPT_ROWS}),
tokens AS (
  SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term
  FROM corpus
),
postings AS (SELECT id, term, count(*) AS tf FROM tokens GROUP BY id, term),
vocabulary AS (
  SELECT term, sum(tf) AS cf, count(*) AS df FROM postings GROUP BY term
  ORDER BY cf DESC, term LIMIT 5000
),
scaled AS (
  SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM corpus)) / (1.0::DOUBLE + df)) + 1) AS x
  FROM postings JOIN vocabulary USING (term)
),
weights AS (
  SELECT id, term, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM scaled
),
margins AS (
  SELECT c.id, i.class, i.intercept + coalesce(s.part, 0) AS m
  FROM corpus c CROSS JOIN intercepts i
  LEFT JOIN (SELECT id, class, sum(coef * weight) AS part FROM weights JOIN model USING (term)
    GROUP BY id, class) s ON s.id = c.id AND s.class = i.class
),
best AS (
  SELECT id, arg_min(class, (-m, class)) AS class, max(m) AS top FROM margins GROUP BY id
)
SELECT b.id, CASE WHEN class = 'unlisted' THEN 'other' ELSE class END AS category,
  round(1 / (SELECT sum(exp(m - b.top)) FROM margins WHERE margins.id = b.id), 6) AS confidence
FROM best b"""


def classify_train(spark: SparkSession, sf: str) -> DataFrame:
    """A model trained on the labelled documents, applied to all documents."""
    documents = v.table(spark, sf, "documents").select("doc_id", "text")
    labels = v.table(spark, sf, "labels")
    labelled = documents.join(labels, "doc_id").select(
        "text", F.col("quality").cast("string").alias("label")
    )
    return predict(train(labelled), documents, coerce=False).select(
        "doc_id", "category", F.round("category_confidence", 4).alias("category_confidence")
    )


def classify_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a trained model that was saved and loaded, with their weights by rarity; without
    the terms that tie at the end of its vocabulary."""
    labelled = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id")
    path = scratch_path(spark, "model")
    save(train(labelled.select("text", F.col("quality").cast("string").alias("label"))), path)
    model = load_or_train(spark, path)
    known = zip(model.stages[2].vocabulary, model.stages[3].idf.toArray().tolist(), strict=True)
    rarity = spark.createDataFrame(list(known), "term string, idf double")
    counted = written(term_stats(postings(labelled.select(F.col("doc_id").alias("id"), "text"))), "terms")
    first = counted.orderBy(F.desc("cf"), "term").limit(CLASSIFIER_TERMS + 1)
    cut = first.agg(F.when(F.count("*") > CLASSIFIER_TERMS, F.min("cf")).otherwise(0)).scalar()
    return counted.filter(F.col("cf") > cut).join(rarity, "term", "left").select(
        "term", "df", F.round("idf", 9).alias("idf")
    )


CLASSIFY_TERMS = f"""WITH labelled AS (
  SELECT doc_id AS id, text FROM documents JOIN labels USING (doc_id)
),
stop_words(word) AS (VALUES {v.values_list(ENGLISH)}),
tokens AS (
  SELECT id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM labelled
),
counted AS (
  SELECT term, count(*) AS cf, count(DISTINCT id) AS df FROM tokens
  WHERE term NOT IN (SELECT word FROM stop_words) GROUP BY term
)
SELECT term, df, round(ln((1.0::DOUBLE + (SELECT count(*) FROM labelled)) / (1 + df)), 9) AS idf
FROM counted
WHERE cf > coalesce((SELECT cf FROM counted ORDER BY cf DESC, term LIMIT 1 OFFSET 5000), 0)"""


def classify_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by the model trained on the seed texts."""
    documents = v.document_records(spark, sf).withColumn(
        "text", F.concat("title", F.lit(" "), "description")
    )
    return predict(train_from_seed(spark), documents).select(
        "doc_id", "category", F.round("category_confidence", 4).alias("category_confidence")
    )


QUERIES = {
    "document_text": (document_texts, DOCUMENT_TEXTS),
    "term_stats": (terms, TERMS),
    "vocabulary_top": (vocabulary_top, VOCABULARY_TOP),
    "tfidf_weights": (tfidf_weights, TFIDF_WEIGHTS),
    "near_duplicates": (near_duplicates, NEAR_DUPLICATES),
    "near_duplicates_cut": (near_duplicates_cut, NEAR_DUPLICATES),
    "duplicate_copies": (duplicate_copies, DUPLICATE_COPIES),
    "near_duplicate_count": (near_duplicate_count, NEAR_DUPLICATE_COUNT),
    "duplicate_partner_counts": (partner_counts, PARTNER_COUNTS),
    "duplicate_partners": (partners, PARTNERS),
    "duplicate_clusters": (clusters, CLUSTERS),
    "approximate_duplicates": (approximate_duplicates, NEAR_DUPLICATES),
    "process_summary": (process_summary, PROCESS_SUMMARY),
    "curated_records": (curated_records, CURATED_RECORDS),
    "classify_score": (classify_score, CLASSIFY_SCORE),
    "classify_terms": (classify_terms, CLASSIFY_TERMS),
    "classify_train": (classify_train, None),
    "classify_documents": (classify_documents, None),
}
