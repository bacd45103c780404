"""The registered queries of the training-data operators and the SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from crosspanel.llm import (
    centroids, decontaminate, fixity, langid, linededup, neardup, packing, pieces, quality, sharding, toxicity, vafile, whitening,
)
from crosspanel.llm.base import crc_fold, scan, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    """The vocabulary file of the packing contract, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = written(packing.cut(scan(spark, sf_dir, "documents"), tokenizer_path()), "pieces")
    return packing.pack_pieces(pieces)


@query
def op2_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels")
    held = crc_fold(F.col("doc_id"), 5) == 0
    trusted = toxicity.learnable(labels, "quality", 5, 0).where(F.col("label") == 1)
    model = quality.train(docs.where(~held), trusted, labels)
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op3_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    held = crc_fold(F.col("doc_id"), 5) == 0
    model = langid.train(docs.where(~held))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score"
    )


@query
def op4_sparse_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "labels")
    model = toxicity.train(docs, toxicity.learnable(labels, "toxic", 4, 2))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op5_vector_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scan(spark, sf_dir, "embeddings")
    return vafile.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors)


SQL["op5_vector_file_search"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, v.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def damaged(pages: DataFrame) -> DataFrame:
    """The second replica of the audit: ``layout`` of ``pages`` with faults planted by a hash of the id."""
    records = fixity.layout(pages)
    place = F.conv(F.substring(F.sha2(F.col("page_id").cast("string"), 256), 1, 2), 16, 10).cast("int")
    flipped = F.when(place < 8, F.reverse("digest")).otherwise(F.col("digest"))
    short = F.when(place.between(12, 15), F.col("length") - 1).otherwise(F.col("length"))
    return records.where(F.coalesce(~place.between(8, 11), F.lit(True))).withColumn("digest", flipped).withColumn("length", short)


@query
def op6_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = scan(spark, sf_dir, "pages")
    return fixity.audit(fixity.layout(pages), damaged(pages))


SQL["op6_merkle_fixity"] = r"""
WITH records AS (
  SELECT page_id, CAST(floor(page_id / 256.0) AS BIGINT) AS archive, CAST(
    length('WARC/1.0') + length('WARC-Type: resource') + length('WARC-Record-ID: <urn:page:>') + length('WARC-Target-URI: ')
    + length('Content-Length: ') + 16 + length(CAST(page_id AS VARCHAR)) + strlen(coalesce(url, ''))
    + length(CAST(strlen(coalesce(html, '')) AS VARCHAR)) + strlen(coalesce(html, '')) AS BIGINT) AS length,
    substr(sha256(CAST(page_id AS VARCHAR)), 1, 2) AS h
  FROM pages
), placed AS (
  SELECT *, CAST(coalesce(sum(length) OVER (
    PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM records
)
SELECT archive, "offset", length,
  CASE WHEN h BETWEEN '08' AND '0b' THEN NULL WHEN h >= '0c' THEN length - 1 ELSE length END AS replica_length,
  CASE WHEN h BETWEEN '08' AND '0b' THEN 'missing' ELSE 'changed' END AS kind
FROM placed WHERE h < '10'
"""


@query
def op8_containment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = scan(spark, sf_dir, "documents"), scan(spark, sf_dir, "benchmark")
    return decontaminate.contained_items(docs, items).select("doc_id", "item_id", "shared", "n")


SQL["op8_containment_search"] = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM texts
), shingles AS MATERIALIZED (
  SELECT kind, id, unnest(list_distinct(list_transform(range(1, len(w) - 3),
    lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]))) AS s
  FROM words WHERE len(w) >= 5
), items AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'b' GROUP BY id
), found AS (
  SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared
  FROM shingles AS d JOIN shingles AS b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' GROUP BY 1, 2
)
SELECT doc_id, item_id, shared, n FROM found JOIN items ON items.id = item_id WHERE 100 * shared >= 80 * n
"""


@query
def op7_line_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(scan(spark, sf_dir, "documents")).select(
        "doc.doc_id", F.col("removed").cast("long").alias("removed"), F.sha2("text", 256).alias("text_sha256")
    )


SQL["op7_line_set_join"] = r"""
WITH split AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents
), numbered AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS line_no FROM split
), worded AS MATERIALIZED (
  SELECT doc_id, line_no, line, list_sort(list_distinct(regexp_extract_all(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'))) AS w
  FROM numbered
), sets AS MATERIALIZED (
  SELECT w, len(w) AS n, min(doc_id * 1000000 + line_no) AS place FROM worded WHERE len(w) >= 1 GROUP BY w
), tokens AS MATERIALIZED (SELECT place, n, unnest(w) AS t FROM sets
), counted AS (SELECT t, count(*) AS df FROM tokens GROUP BY t
), ranked AS (
  SELECT place, n, t, row_number() OVER (PARTITION BY place ORDER BY df, t) AS r FROM tokens JOIN counted USING (t)
), prefix AS MATERIALIZED (SELECT place, n, t FROM ranked WHERE r <= n - CAST(ceil(0.8 * n) AS BIGINT) + 1
), pairs AS (
  SELECT DISTINCT x.place AS px, y.place AS py FROM prefix AS x JOIN prefix AS y
    ON x.t = y.t AND x.place < y.place AND 5 * least(x.n, y.n) >= 4 * greatest(x.n, y.n)
), matched AS (
  SELECT DISTINCT py FROM (
    SELECT py, x.n AS nx, y.n AS ny, len(list_intersect(x.w, y.w)) AS c
    FROM pairs JOIN sets AS x ON x.place = px JOIN sets AS y ON y.place = py)
  WHERE 5 * c >= 4 * (nx + ny - c)
), marked AS (
  SELECT worded.doc_id, line_no, line,
         sets.place IS NOT NULL AND (sets.place <> doc_id * 1000000 + line_no OR py IS NOT NULL) AS gone
  FROM worded LEFT JOIN sets USING (w) LEFT JOIN matched ON py = sets.place
), joined AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS removed,
         coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(removed, 0) AS removed, sha256(coalesce(j.text, d.text)) AS text_sha256
FROM documents AS d LEFT JOIN joined AS j USING (doc_id)
"""


@query
def op9_hamming_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(scan(spark, sf_dir, "documents"), 3, 85)


SQL["op9_hamming_duplicates"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE
    WHEN w IS NULL OR len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  END AS s FROM words
), shingles AS MATERIALIZED (SELECT doc_id, unnest(s) AS s FROM sets),
sizes AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT x, y FROM common JOIN sizes AS p ON p.doc_id = x JOIN sizes AS q ON q.doc_id = y
  WHERE 100 * c >= 85 * (p.n + q.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sizes
  UNION
  SELECT r.x, l.y FROM reach AS r JOIN links AS l ON r.y = l.x
), smallest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN smallest ON x = doc_id
"""


@query
def op10_exact_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = scan(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    return sharding.shuffle_to_shards(rows, 8).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def piece_model_path() -> str:
    """The merge-type model of the encoding contract, from the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op11_backtracking_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = scan(spark, sf_dir, "documents").select("doc_id", "text"), piece_model_path()
    encoded = pieces.encode_texts(docs.select(F.struct("doc_id").alias("key"), "text"), path)
    ids = F.col("row.ids")
    return pieces.decode_ids(encoded.select("doc.key.doc_id", "ids"), path).select(
        "row.doc_id",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op12_exact_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(scan(spark, sf_dir, "embeddings"))


@query
def op13_ptolemaic_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(scan(spark, sf_dir, "embeddings"))


def lloyd_sql(rounds: int = 10, clusters: int = 8) -> str:
    """Plain Lloyd rounds, unrolled: nearest centroid over all pairs, floored means, empty centroids kept."""
    square = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        """v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)""",
        f"""c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS INTEGER) AS c, x FROM v
  ORDER BY c LIMIT {clusters}
)""",
    ]
    for r in range(rounds + 1):
        parts.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, x, best.c AS c, best.d AS d FROM (
    SELECT v.vec_id, any_value(v.x) AS x, min({{'d': CAST({square} AS BIGINT), 'c': c.c}}) AS best
    FROM v CROSS JOIN c{r} AS c GROUP BY v.vec_id)
)""")
        if r < rounds:
            parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT old.c, coalesce(new.x, old.x) AS x FROM c{r} AS old LEFT JOIN (
    SELECT c, list(((s - ((s % n + n) % n)) // n) ORDER BY i) AS x FROM (
      SELECT c, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n
      FROM (SELECT c, unnest(x) AS e, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i)
    GROUP BY c) AS new USING (c)
)""")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(cc.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS cc USING (c)
"""


SQL["op13_ptolemaic_clusters"] = lloyd_sql()
