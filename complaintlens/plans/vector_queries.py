"""Registered queries on vectors: normalisation, search, embedding, index, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from complaintlens.functions import vectors as V
from complaintlens.operators import embedding, packed, pruned, retrieval, sampling
from complaintlens.options import JobOptions
from complaintlens.plans import inputs as I
from complaintlens.plans import jobs
from complaintlens.plans.registry import query
from complaintlens.plans.text_queries import SAMPLE_SQL, SAMPLE_TARGET
from complaintlens.session import scratch_dir, written_once
from complaintlens.sources import collection, columns, complaints, exports, lookup, split_csv
from complaintlens.streaming import ingest

# The stored vectors of the test tables are 64 wide.
WIDTH = 64
HASH_WIDTH = 128


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return I.table(spark, folder, "embeddings").select("vec_id", "embedding")


def label_questions(spark: SparkSession, folder: str) -> DataFrame:
    """One question vector per label: the mean of all its vectors."""
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(WIDTH)]
    return (
        I.table(spark, folder, "embeddings")
        .groupBy(F.col("label").alias("question_id"))
        .agg(F.array(*means).alias("question_vec"))
    )


def vector_sum(vector: str) -> Column:
    """A vector as one number: the sum of its components weighted with their places."""
    weighted = F.zip_with(
        V.as_doubles(F.col(vector)), F.sequence(F.lit(1), F.size(vector)), lambda x, i: x * i
    )
    return F.aggregate(weighted, F.lit(0.0), lambda total, x: total + x)


_QUESTIONS = """WITH parts AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos
  FROM embeddings),
means AS (SELECT label, pos, avg(x) AS x FROM parts GROUP BY label, pos),
questions AS (SELECT label AS question_id, list(x ORDER BY pos) AS question_vec FROM means GROUP BY label)"""
_SCORED = f"""{_QUESTIONS}, scored AS (SELECT question_id, vec_id,
  round(list_cosine_similarity(embedding::DOUBLE[], question_vec), 12) AS score FROM embeddings, questions),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored)"""
_TOP5 = f"{_SCORED} SELECT question_id, vec_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 5"


def rounded_score(hits: DataFrame) -> DataFrame:
    return hits.withColumn("score", F.round("score", 6))


@query(
    "l2_normalize",
    """SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS pos,
  round(unnest(list_transform(embedding, lambda x: x::DOUBLE
    / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])))), 6) AS x FROM embeddings""",
)
def l2_normalize(spark, folder):
    unit = vectors(spark, folder).select("vec_id", V.l2_normalize(F.col("embedding")).alias("unit"))
    return unit.select("vec_id", F.posexplode("unit").alias("pos", "x")).select(
        "vec_id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x")
    )


@query(
    "dim_violations",
    f"SELECT count(*) AS n_vectors, count(*) FILTER (len(embedding) <> {WIDTH}) AS n_wrong_width, 0::BIGINT AS n_non_finite FROM embeddings",
)
def dim_violations(spark, folder):
    return exports.width_violations(vectors(spark, folder), WIDTH)


@query(
    "observed_checks",
    f"""SELECT count(*) AS n_vectors, count(*) FILTER (len(embedding) <> {WIDTH}) AS n_wrong_width, 0::BIGINT AS n_non_finite,
  count(*) AS streamed_rows, count(*) FILTER (len(embedding) <> {WIDTH}) AS streamed_wrong_width FROM embeddings""",
)
def observed_checks(spark, folder):
    """The checks of dim_violations counted by the jobs that write the vectors: a batch write and a stream, no second pass."""
    path = scratch_dir(spark, "observed-vectors")
    written_figures = exports.write_observed(vectors(spark, folder), path, WIDTH)
    totals = ingest.RunTotals().attach(spark)
    try:
        stream = ingest.observed_stream(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path), WIDTH)
        run = stream.writeStream.format("noop").option("checkpointLocation", scratch_dir(spark, "observed-checkpoint")).trigger(availableNow=True).start()
        run.awaitTermination()
        streamed = totals.of(run)
    finally:
        totals.detach(spark)
    row = (written_figures["n_vectors"], written_figures["n_wrong_width"], written_figures["n_non_finite"], streamed["rows"], streamed.get("n_wrong_width", 0))
    return spark.createDataFrame([row], "n_vectors long, n_wrong_width long, n_non_finite long, streamed_rows long, streamed_wrong_width long")


@query(
    "non_finite",
    f"""WITH dirty AS (SELECT CASE vec_id % 7 WHEN 0 THEN 'NaN'::FLOAT WHEN 1 THEN 'Infinity'::FLOAT WHEN 2 THEN NULL ELSE embedding[1] END AS x,
  len(embedding) AS width FROM embeddings)
SELECT count(*) AS n_vectors, count(*) FILTER (width <> {WIDTH}) AS n_wrong_width,
  count(*) FILTER (x IS NULL OR NOT isfinite(x)) AS n_non_finite FROM dirty""",
)
def non_finite(spark, folder):
    """All vectors, some with a NaN, an infinite or a missing component put in."""
    kind = F.pmod("vec_id", F.lit(7))
    first = F.when(kind == 0, F.lit(float("nan"))).when(kind == 1, F.lit(float("inf"))).when(kind == 2, F.lit(None))
    first = first.otherwise(F.get("embedding", F.lit(0))).cast("float")
    dirty = vectors(spark, folder).withColumn("embedding", F.concat(F.array(first), F.slice("embedding", 2, WIDTH)))
    return exports.width_violations(dirty, WIDTH)


# --- search ----------------------------------------------------------------


@query(
    "topk_cosine",
    """WITH parts AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
means AS (SELECT pos, avg(x) AS x FROM parts GROUP BY pos),
q AS (SELECT list(x ORDER BY pos) AS v FROM means),
s AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 12) AS score FROM embeddings, q)
SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 5""",
)
def topk_cosine(spark, folder):
    """One question, the mean of all vectors."""
    stored = vectors(spark, folder)
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(WIDTH)]
    question = stored.agg(F.array(*means)).first()[0]  # one vector
    return rounded_score(retrieval.top_k_single(stored, question, "vec_id", "embedding", 5))


@query("topk_cosine_batch", _TOP5)
def topk_cosine_batch(spark, folder):
    hits = retrieval.retrieve(
        vectors(spark, folder), label_questions(spark, folder), 5, WIDTH, "vec_id", "embedding"
    )
    return rounded_score(hits)


@query("topk_cosine_block", _TOP5)
def topk_cosine_block(spark, folder):
    """The same with the questions in slices of about three."""
    hits = retrieval.retrieve(
        vectors(spark, folder), label_questions(spark, folder), 5, WIDTH, "vec_id", "embedding",
        max_question_bytes=3 * 8 * WIDTH,
    )
    return rounded_score(hits)


@query("topk_pruned", _TOP5)
def topk_pruned(spark, folder):
    """topk_cosine_batch over vectors clustered by pivots, reading only clusters whose bound reaches a k-th score."""
    path = scratch_dir(spark, "clustered-vectors")
    pruned.write_clustered(vectors(spark, folder), path, WIDTH, "vec_id", "embedding", pivots=16)
    hits, _, _ = pruned.search_clustered(spark, path, label_questions(spark, folder), 5, WIDTH, "vec_id", "embedding")
    return rounded_score(hits)


@query("topk_packed", _TOP5)
def topk_packed(spark, folder):
    """The same from vectors packed in float32 blocks: a float32 pass with an error bound, exact rescoring of candidates."""
    path = scratch_dir(spark, "packed-vectors")
    packed.pack_vectors(vectors(spark, folder), "vec_id", "embedding", WIDTH).write.option("compression", "none").parquet(path)
    hits = packed.search_packed(spark.read.parquet(path), label_questions(spark, folder), 5, WIDTH, "vec_id")
    return rounded_score(hits)


@query(
    "topk_k_gt_n",
    f"""{_QUESTIONS}, pairs AS (SELECT a.question_id, b.question_id AS label,
  round(list_cosine_similarity(b.question_vec, a.question_vec), 12) AS score FROM questions a, questions b)
SELECT question_id, label, round(score, 6) AS score,
  CAST(row_number() OVER (PARTITION BY question_id ORDER BY pairs.score DESC, label) AS INTEGER) AS rank FROM pairs""",
)
def topk_k_gt_n(spark, folder):
    """More hits asked for than there are vectors: the mean vectors against themselves."""
    means = label_questions(spark, folder)
    stored = means.select(F.col("question_id").alias("label"), F.col("question_vec").alias("embedding"))
    return rounded_score(retrieval.retrieve(stored, means, 1000, WIDTH, "label", "embedding"))


@query(
    "retrieve_sources",
    f"""{_SCORED}, cc AS ({I._CC}), mapped AS (SELECT *, {I._sql_category('product')} AS product_category FROM cc)
SELECT question_id, vec_id, round(score, 6) AS score, rank, product_category, company, state, narrative
FROM ranked LEFT JOIN mapped ON vec_id = complaint_id WHERE rank <= 5""",
)
def retrieve_sources(spark, folder):
    hits = retrieval.retrieve(
        vectors(spark, folder), label_questions(spark, folder), 5, WIDTH, "vec_id", "embedding"
    )
    metadata = I.mapped(spark, folder).select(
        F.col("complaint_id").alias("vec_id"), "product_category", "company", "state", "narrative"
    )
    return rounded_score(retrieval.attach_metadata(hits, metadata, "vec_id"))


@query(
    "retrieve_sources_lookup",
    f"""{_SCORED}, cc AS ({I._CC}), mapped AS (SELECT *, {I._sql_category('product')} AS product_category FROM cc)
SELECT question_id, vec_id, round(score, 6) AS score, rank, product_category, company, state, narrative
FROM ranked LEFT JOIN mapped ON vec_id = complaint_id WHERE rank <= 5""",
)
def retrieve_sources_lookup(spark, folder):
    """retrieve_sources with the metadata stored by key range with bloom filters, read only where hit keys can be."""
    hits = written_once(retrieval.retrieve(vectors(spark, folder), label_questions(spark, folder), 5, WIDTH, "vec_id", "embedding"), "hits")
    metadata = I.mapped(spark, folder).select(F.col("complaint_id").alias("vec_id"), "product_category", "company", "state", "narrative")
    path = scratch_dir(spark, "metadata-by-key")
    lookup.write_lookup_table(metadata, path, "vec_id", rows_per_file=2_000)
    return rounded_score(lookup.attach_looked_up(hits, path, "vec_id"))


@query(
    "self_retrieval",
    """WITH g AS (SELECT label, count(*) AS n FROM embeddings WHERE label IS NOT NULL GROUP BY label),
t AS (SELECT label, least(CAST(round_even(n / CAST(sum(n) OVER () AS DOUBLE) * 50.0::DOUBLE, 0) AS BIGINT), n) AS target FROM g),
r AS (SELECT e.*, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(vec_id AS VARCHAR))), vec_id) AS rk
  FROM embeddings e),
sample AS (SELECT r.vec_id, embedding FROM r LEFT JOIN t USING (label) WHERE rk <= target OR vec_id % 50 = 0),
scored AS (SELECT s.vec_id AS question_id, e.vec_id AS hit_id,
  round(list_cosine_similarity(e.embedding::DOUBLE[], s.embedding::DOUBLE[]), 12) AS score FROM sample s, embeddings e),
best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, hit_id) AS rk FROM scored)
SELECT question_id, hit_id, round(score, 6) AS score, hit_id = question_id AND score > 0.999 AS found_itself
FROM best WHERE rk = 1""",
)
def self_retrieval(spark, folder):
    """Every vector whose id is divisible by 50, and beside them 50 stratified by label, ask for their best hit among all vectors."""
    stored = I.table(spark, folder, "embeddings")
    divisible = F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False))
    others = sampling.stratified_sample(stored, "label", 50, "vec_id").filter(~divisible)
    return rounded_score(retrieval.self_retrieval(stored, stored.filter(divisible).unionByName(others), WIDTH, "vec_id"))


# --- embedding -------------------------------------------------------------

_TOKENS = f"""{I.WITH_CLEAN}, tokens AS (SELECT complaint_id, unnest(string_split(clean_narrative, ' ')) AS token FROM clean),
buckets AS (SELECT complaint_id, CAST(('0x' || substr(md5(token), 1, 8))::BIGINT % {HASH_WIDTH} AS INTEGER) AS bucket,
  count(*) AS n FROM tokens WHERE token <> '' GROUP BY ALL)"""


@query("hash_embed", f"{_TOKENS} SELECT complaint_id, bucket, n FROM buckets")
def hash_embed(spark, folder):
    return embedding.hashed_buckets(
        I.cleaned(spark, folder), "complaint_id", "clean_narrative", HASH_WIDTH
    )


@query(
    "embed_vectors",
    f"""{_TOKENS}, lengths AS (SELECT complaint_id, sqrt(sum(n * n)::DOUBLE) AS length FROM buckets GROUP BY complaint_id)
SELECT complaint_id, bucket, round((n / length)::FLOAT::DOUBLE, 5) AS x FROM buckets JOIN lengths USING (complaint_id)""",
)
def embed_vectors(spark, folder):
    """The same counts as unit vectors, by the injected embedder."""
    rows = embedding.embed(
        I.cleaned(spark, folder).select("complaint_id", "clean_narrative"),
        "clean_narrative",
        embedding.hashed(HASH_WIDTH),
    )
    return (
        rows.select("complaint_id", F.posexplode("embedding").alias("bucket", "x"))
        .filter(F.col("x") != 0)
        .withColumn("x", F.round(F.col("x").cast("double"), 5))
    )


@query(
    "embed_norms",
    f"""{_TOKENS} SELECT complaint_id, CAST({HASH_WIDTH} AS INTEGER) AS width, 1.0::DOUBLE AS length,
  count(*) AS n_nonzero, max(n) FILTER (n = most) / sqrt(sum(n * n)::DOUBLE) > 0.5 AS one_dominates
FROM (SELECT *, max(n) OVER (PARTITION BY complaint_id) AS most FROM buckets) GROUP BY complaint_id""",
)
def embed_norms(spark, folder):
    rows = embedding.embed(
        I.cleaned(spark, folder).select("complaint_id", "clean_narrative"),
        "clean_narrative",
        embedding.hashed(HASH_WIDTH),
    )
    return rows.select(
        "complaint_id",
        F.size("embedding").alias("width"),
        F.round(V.norm(F.col("embedding")), 5).alias("length"),
        F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("n_nonzero"),
        (F.array_max("embedding") > 0.5).alias("one_dominates"),
    )


@query(
    "chunk_vector_table",
    I.recursive(
        f"""{SAMPLE_SQL}, base AS (SELECT complaint_id AS id, clean_narrative AS text FROM sample),
{I.sql_chunks('base', 500, 50)},
token AS (SELECT id, chunk_index, unnest(string_split(chunk_text, ' ')) AS t FROM chunks),
bucket AS (SELECT id, chunk_index, ('0x' || substr(md5(t), 1, 8))::BIGINT % {HASH_WIDTH} AS b, count(*) AS n
  FROM token WHERE t <> '' GROUP BY ALL),
lengths AS (SELECT id, chunk_index, sqrt(sum(n * n)::DOUBLE) AS length FROM bucket GROUP BY ALL),
summed AS (SELECT id, chunk_index, sum((b + 1) * (n / length)::FLOAT::DOUBLE) AS total
  FROM bucket JOIN lengths USING (id, chunk_index) GROUP BY ALL)
SELECT concat(id, '_', chunk_index) AS chunk_id, complaint_id, chunk_index, total_chunks, chunk_text, product_category,
  product, issue, company, state, date_received, round(total, 3) AS vec_check
FROM chunks JOIN summed USING (id, chunk_index) JOIN clean ON complaint_id = id"""
    ),
)
def chunk_vector_table(spark, folder):
    """From the cleaned table to sampled, chunked and embedded rows."""
    options = JobOptions(sample_size=SAMPLE_TARGET, vector_width=HASH_WIDTH)
    chunks = jobs.chunks_with_vectors(I.stored_cleaned(spark, folder), options)
    return chunks.withColumn("vec_check", vector_check()).drop("embedding")


# --- exports, index, metadata ----------------------------------------------


def nested_export(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors that have a complaint, with text and nested metadata, at three times their length."""
    stored = vectors(spark, folder).withColumnRenamed("vec_id", "complaint_id")
    longer = F.transform("embedding", lambda x: (x.cast("double") * 3).cast("float"))
    joined = stored.join(I.mapped(spark, folder), "complaint_id")
    return joined.select(
        F.concat(F.col("complaint_id").cast("string"), F.lit("_0")).alias("id"),
        F.col("narrative").alias("document"),
        longer.alias("embedding"),
        F.struct("complaint_id", "product_category", "product", "company", "state").alias("metadata"),
    )


def flat_export(spark: SparkSession, folder: str) -> DataFrame:
    """The same with flat metadata under other names, and columns that no reader needs."""
    nested = nested_export(spark, folder)
    return nested.select(
        F.col("id").alias("ID"),
        F.col("document").alias("text"),
        F.col("embedding").alias("Vector"),
        F.col("metadata.complaint_id").alias("Complaint ID"),
        F.col("metadata.product").alias("product"),
        F.col("metadata.company").alias("company"),
        F.length("document").alias("n_letters"),
        F.lit("unused").alias("remark"),
    )


def written(df: DataFrame, purpose: str) -> str:
    path = scratch_dir(df.sparkSession, purpose)
    exports.write_chunk_vectors(df, path)
    return path


def vector_check(vector: str = "embedding"):
    return F.round(vector_sum(vector), 3)


_EXPORT = f"""{I.WITH_CC}, e AS (SELECT complaint_id, narrative, product_category, product, company, state,
  list_transform(embedding, lambda x: (x::DOUBLE * 3)::FLOAT::DOUBLE) AS v
  FROM embeddings JOIN mapped ON vec_id = complaint_id),
u AS (SELECT *, list_transform(v, lambda x: (x / sqrt(list_dot_product(v, v)))::FLOAT::DOUBLE) AS unit FROM e)"""


def _check_sql(vector: str) -> str:
    return (
        f"round(list_sum(list_transform(range(1, {WIDTH + 1}), lambda i: {vector}[i] * i)), 3) AS vec_check"
    )


_INDEX = f"""{_EXPORT} SELECT concat(complaint_id, '_0') AS chunk_id, narrative AS chunk_text, complaint_id,
  product_category, product, company, state, {_check_sql('unit')} FROM u"""


def _with_check(df: DataFrame) -> DataFrame:
    return df.withColumn("vec_check", vector_check()).drop("embedding")


@query("index_build", _INDEX)
def index_build(spark, folder):
    path = written(nested_export(spark, folder), "export")
    index = written(exports.build_index(spark, path, WIDTH), "index")
    return _with_check(exports.load_embeddings(spark, index))


@query("ingest_stream", _INDEX)
def ingest_stream(spark, folder):
    path = written(nested_export(spark, folder).repartition(3, "id"), "export")
    table = scratch_dir(spark, "ingested")
    schema = spark.read.parquet(path).schema
    ingest.ingest_vectors_stream(spark, path, table, schema, WIDTH, files_per_batch=1).awaitTermination()
    return _with_check(spark.read.parquet(table))


@query(
    "ingest_once",
    f"""{_EXPORT} SELECT concat(complaint_id, '_0') AS chunk_id, coalesce(narrative, '') AS chunk_text, complaint_id,
  coalesce(product_category, '') AS product_category, coalesce(product, '') AS product, coalesce(company, '') AS company,
  coalesce(state, '') AS state, {_check_sql('unit')} FROM u""",
)
def ingest_once(spark, folder):
    """The export streamed into a collection, a file at a time, then its files again (a replay): every id once."""
    path = written(nested_export(spark, folder).repartition(3, "id"), "export")
    schema = spark.read.parquet(path).schema
    name = "ingested_" + scratch_dir(spark, "x").rsplit("-", 1)[1]
    home, checkpoint = scratch_dir(spark, "ingested-collection"), scratch_dir(spark, "ingested-checkpoint")
    ingest.ingest_collection_stream(spark, path, name, schema, WIDTH, home, checkpoint, files_per_batch=1).awaitTermination()
    # The same files under new names: the stream takes them as new, the collection holds their ids already.
    spark.read.parquet(path).repartition(2).write.mode("append").parquet(path)
    ingest.ingest_collection_stream(spark, path, name, schema, WIDTH, home, checkpoint, files_per_batch=1).awaitTermination()
    return _with_check(spark.table(name))


@query(
    "detect_alt_names",
    f"""{_EXPORT} SELECT concat(complaint_id, '_0') AS chunk_id, narrative AS chunk_text,
  complaint_id AS "Complaint ID", product, company, {_check_sql('unit')} FROM u""",
)
def detect_alt_names(spark, folder):
    path = written(flat_export(spark, folder), "flat-export")
    return _with_check(exports.build_index(spark, path, WIDTH))


@query(
    "scan_pruned",
    f"""{_EXPORT} SELECT narrative AS text, complaint_id AS "Complaint ID", product, company,
  concat(complaint_id, '_0') AS "ID", {_check_sql('v')} FROM u""",
)
def scan_pruned(spark, folder):
    raw, found = exports.read_vectors(spark, written(flat_export(spark, folder), "flat-export"))
    return raw.withColumn("vec_check", vector_check(found.vector)).drop(found.vector)


@query(
    "expand_struct",
    f"""{_EXPORT} SELECT concat(complaint_id, '_0') AS id, complaint_id, product_category, product, company, state FROM u""",
)
def expand_struct(spark, folder):
    export = nested_export(spark, folder).select("id", "metadata")
    return exports.expand_metadata(export, "metadata")


@query(
    "expand_json",
    """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def expand_json(spark, folder):
    events = I.table(spark, folder, "events").select("event_id", "event_type", "props")
    return exports.expand_metadata(events, "props")


@query(
    "variant_stream",
    """SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""",
)
def variant_stream(spark, folder):
    """The events streamed with their JSON kept as VARIANT (no schema pass), stored, and key k read from the stored table."""
    source, target = scratch_dir(spark, "events-json"), scratch_dir(spark, "events-variant")
    I.table(spark, folder, "events").select("event_id", "event_type", "props").write.parquet(source)
    stream = spark.readStream.schema("event_id long, event_type string, props string").parquet(source)
    query = (
        exports.metadata_as_variant(stream, "props")
        .writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", scratch_dir(spark, "events-variant-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return exports.metadata_values(spark.read.parquet(target), "props", {"k": "bigint"})


@query(
    "metadata_table",
    f"""{_EXPORT} SELECT concat(complaint_id, '_0') AS chunk_id, narrative AS chunk_text,
  complaint_id, product_category, product, company, state FROM u""",
)
def metadata_table(spark, folder):
    wide = exports.expand_metadata(nested_export(spark, folder), "metadata")
    path = scratch_dir(spark, "metadata")
    exports.write_metadata(exports.to_metadata(wide), path)
    return spark.read.parquet(path)


@query(
    "vector_roundtrip",
    f"""{_EXPORT} SELECT concat(complaint_id, '_0') AS id, narrative AS document, complaint_id,
  {_check_sql('v')} FROM u""",
)
def vector_roundtrip(spark, folder):
    export = nested_export(spark, folder).withColumn("complaint_id", F.col("metadata.complaint_id"))
    path = written(export.drop("metadata"), "chunk-vectors")
    return _with_check(exports.load_embeddings(spark, path))


@query(
    "index_mismatch",
    f"""{I.WITH_CC}, v AS (SELECT vec_id AS k, count(*) AS n FROM embeddings GROUP BY 1),
m AS (SELECT complaint_id AS k, count(*) AS n FROM cc GROUP BY 1),
b AS (SELECT coalesce(v.n, 0) AS v, coalesce(m.n, 0) AS m FROM v FULL JOIN m USING (k))
SELECT CAST(sum(v) AS BIGINT) AS n_vectors, CAST(sum(m) AS BIGINT) AS n_metadata,
  count(*) FILTER (m = 0) AS only_vectors, count(*) FILTER (v = 0) AS only_metadata,
  count(*) FILTER (v <> m) AS unequal_keys FROM b""",
)
def index_mismatch(spark, folder):
    stored = vectors(spark, folder).withColumnRenamed("vec_id", "complaint_id")
    return exports.index_mismatch(stored, I.complaints(spark, folder), "complaint_id")


@query(
    "key_differences",
    f"""{I.WITH_CC}, v AS (SELECT vec_id AS k, count(*) AS n FROM embeddings GROUP BY 1),
m AS (SELECT complaint_id AS k, count(*) AS n FROM cc GROUP BY 1)
SELECT k AS complaint_id, coalesce(v.n, 0) AS n_vectors, coalesce(m.n, 0) AS n_metadata
FROM v FULL JOIN m USING (k) WHERE coalesce(v.n, 0) <> coalesce(m.n, 0)""",
)
def key_differences(spark, folder):
    stored = vectors(spark, folder).withColumnRenamed("vec_id", "complaint_id")
    return exports.key_differences(stored, I.complaints(spark, folder), "complaint_id")


@query("index_count", "SELECT count(*) AS n_vectors FROM embeddings")
def index_count(spark, folder):
    return exports.index_count(vectors(spark, folder))


@query(
    "fill_metadata",
    f"""{I.WITH_CC} SELECT complaint_id, coalesce(product_category, '') AS product_category,
  coalesce(product, '') AS product, coalesce(issue, '') AS issue, coalesce(state, '') AS state FROM mapped""",
)
def fill_metadata(spark, folder):
    return exports.fill_metadata(
        I.mapped(spark, folder).select("complaint_id", "product_category", "product", "issue", "state")
    )


@query(
    "schema_align",
    """SELECT event_id, CAST(user_id AS DOUBLE) AS user_id, event_type, value FROM events
UNION ALL SELECT o_orderkey, CAST(o_custkey AS DOUBLE), NULL, CAST(o_totalprice AS DOUBLE) FROM orders""",
)
def schema_align(spark, folder):
    """A second export with other types, column order and a missing column, under the first's schema."""
    first = I.table(spark, folder, "events").select(
        "event_id", F.col("user_id").cast("double").alias("user_id"), "event_type", "value"
    )
    second = I.table(spark, folder, "orders").select(
        F.col("o_totalprice").alias("value"),
        F.col("o_custkey").cast("int").alias("user_id"),
        F.col("o_orderkey").cast("string").alias("event_id"),
    )
    return exports.append_batches(first, second)


@query(
    "batches_union",
    """SELECT event_id, event_type, value, NULL::BIGINT AS custkey, NULL AS status FROM events
UNION ALL SELECT CAST(o_orderkey AS BIGINT), NULL, CAST(o_totalprice AS DOUBLE), CAST(o_custkey AS BIGINT), o_orderstatus FROM orders""",
)
def batches_union(spark, folder):
    """A second export that lacks a column of the first and has two of its own."""
    first = I.table(spark, folder, "events").select("event_id", "event_type", "value")
    second = I.table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("value"),
        F.col("o_custkey").cast("long").alias("custkey"), F.col("o_orderkey").alias("event_id"),
    )
    return exports.append_batches(first, second)


@query(
    "expand_clash",
    """SELECT event_id, event_type, user_id AS meta_event_id, value AS "meta_EVENT_TYPE", event_type AS "VOID" FROM events""",
)
def expand_clash(spark, folder):
    """Metadata keys named like columns of the table, in JSON."""
    keys = F.struct(F.col("user_id").alias("event_id"), F.col("value").alias("EVENT_TYPE"), F.col("event_type").alias("VOID"))
    rows = I.table(spark, folder, "events").select("event_id", "event_type", F.to_json(keys).alias("meta"))
    wide = exports.expand_metadata(rows, "meta")
    # Numbers in JSON are typed by what they look like.
    return wide.withColumns({"meta_event_id": F.col("meta_event_id").cast("long"), "meta_EVENT_TYPE": F.col("meta_EVENT_TYPE").cast("double")})


@query(
    "collection_new_column",
    """SELECT concat(doc_id, '_0') AS chunk_id, lang, CASE WHEN lang <> 'en' THEN source END AS source FROM documents""",
)
def collection_new_column(spark, folder):
    """The English documents, then all documents with a further column appended."""
    rows = I.table(spark, folder, "documents").select(F.concat_ws("_", "doc_id", F.lit("0")).alias("chunk_id"), "lang", "source")
    path = scratch_dir(spark, "collection")
    name = "documents_" + path.rsplit("-", 1)[1]
    collection.write_collection(rows.filter("lang = 'en'").drop("source"), name, path)
    collection.write_collection(rows, name, reset=False)
    return spark.table(name)


@query(
    "search_without_id",
    """WITH q AS (SELECT vec_id, embedding AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.vec_id AS question_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v::DOUBLE[]), 12) AS score FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT question_id, concat('vector ', vec_id) AS chunk_text, round(score, 6) AS score FROM r WHERE rank = 1""",
)
def search_without_id(spark, folder):
    """An export without an id column: its rows are told apart by file and place."""
    stored = vectors(spark, folder)
    export = stored.select(F.concat(F.lit("vector "), "vec_id").alias("text"), "embedding")
    index = exports.build_index(spark, written(export, "export-without-id"), WIDTH)
    questions = stored.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("question_vec"))
    path = written(index, "index")
    table = exports.load_embeddings(spark, path)
    hits = retrieval.attach_metadata(retrieval.retrieve(table, questions, 1, WIDTH), table.drop("embedding"))
    return rounded_score(hits).select("question_id", "chunk_text", "score")


@query(
    "collection_append",
    f"""{I.WITH_CLEAN} SELECT concat(complaint_id, '_0') AS chunk_id, product_category,
  coalesce(state, '') AS state, clean_narrative FROM clean""",
)
def collection_append(spark, folder):
    """A collection of the commonest category, then all rows appended: every id once."""
    rows = I.cleaned(spark, folder).select(
        F.concat_ws("_", "complaint_id", F.lit("0")).alias("chunk_id"),
        "product_category",
        "state",
        "clean_narrative",
    )
    path = scratch_dir(spark, "collection")
    name = "complaints_" + path.rsplit("-", 1)[1]
    first = rows.filter(F.col("product_category") == "Credit Card")
    collection.write_collection(first, name, path, buckets=8)
    collection.write_collection(rows, name, reset=False, buckets=8)
    return spark.table(name)


# --- complaint tables ------------------------------------------------------


@query(
    "csv_roundtrip",
    f"""{I.WITH_CLEAN} SELECT CAST(complaint_id AS VARCHAR) AS complaint_id, product_category, product,
  CASE WHEN issue IN ('NA', '') THEN NULL ELSE issue END AS issue, company, state, date_received,
  narrative, clean_narrative, CAST(clean_word_count AS VARCHAR) AS clean_word_count FROM clean""",
)
def csv_roundtrip(spark, folder):
    path = scratch_dir(spark, "clean-csv")
    table = columns.select_existing(I.cleaned(spark, folder), complaints.CLEAN_COLUMNS)
    complaints.write_clean_csv(table, path)
    return complaints.read_complaints_csv(spark, path, complaints.CLEAN_COLUMNS)


@query(
    "csv_split",
    f"""{I.WITH_CLEAN} SELECT CAST(complaint_id AS VARCHAR) AS complaint_id, product_category, product,
  CASE WHEN issue IN ('NA', '') THEN NULL ELSE issue END AS issue, company, state, date_received,
  narrative, clean_narrative, CAST(clean_word_count AS VARCHAR) AS clean_word_count FROM clean""",
)
def csv_split(spark, folder):
    """The cleaned table written as CSV and read back in byte ranges, line ends inside cells found by quote parity."""
    path = scratch_dir(spark, "clean-csv-split")
    table = columns.select_existing(I.cleaned(spark, folder), complaints.CLEAN_COLUMNS)
    complaints.write_clean_csv(table, path)
    return split_csv.read_csv_split(spark, path, complaints.CLEAN_COLUMNS)


@query(
    "output_columns",
    f"""{I.WITH_CLEAN} SELECT complaint_id, product_category, product, issue, company, state, date_received,
  narrative, clean_narrative, clean_word_count FROM clean""",
)
def output_columns(spark, folder):
    wanted = [*complaints.CLEAN_COLUMNS, "sub_issue"]
    return columns.select_existing(I.cleaned(spark, folder), wanted)


_RAW_NAMES = {
    "complaint_id": " Complaint ID", "narrative": "Consumer complaint narrative", "product": "Product ",
    "issue": "Issue", "company": "Company", "state": "State", "date_received": "Date (received)",
}


@query(
    "normalize_columns",
    f"""{I.WITH_CC} SELECT complaint_id, narrative AS consumer_complaint_narrative, product, issue, company, state,
  date_received FROM cc""",
)
def normalize_columns(spark, folder):
    return columns.normalize_columns(I.complaints(spark, folder).withColumnsRenamed(_RAW_NAMES))


@query(
    "rename_columns",
    f"""{I.WITH_CC} SELECT complaint_id, narrative, product, issue, company, state, date_received FROM cc""",
)
def rename_columns(spark, folder):
    raw = I.complaints(spark, folder).withColumnsRenamed(_RAW_NAMES)
    return columns.rename_complaint_columns(columns.normalize_columns(raw))


