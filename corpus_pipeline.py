"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from crosspanel.llm import decontaminate, linededup, neardup, packing, toxicity
from crosspanel.llm.base import scan, written
from crosspanel.llm.queries import tokenizer_path

WIDTH, PERCENT = 5, 80


def _row() -> Column:
    return F.xxhash64("doc_id", "text")


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under the threshold; learnt from labels that aren't held out.

    Whole texts are scored.  A null or empty text has no words and is scored by the model's constant alone; a
    null id and other columns, whatever their names, take no part and stay; repeated rows are scored alike; an
    empty table gives no rows.
    """
    labels = toxicity.learnable(scan(spark, sf_dir, "labels"), "toxic", 4, 2)
    score = _free(docs, "_toxicity")
    scored = toxicity.score(docs, toxicity.train(docs, labels), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of any length that an earlier line matches; a document that had words and has none left goes.

    Null and empty texts stay as they are.  Lines are ordered by id (null first), then number: of equal lines the
    first stays.  Rows equal in id and text are one document and are treated alike.  Whole texts are split,
    however long.  Other columns stay, but for n_chars of a changed text.  An empty table gives no rows.
    """
    rows = linededup.dedup_lines(docs, least=1)
    changed = F.col("removed") > 0
    rows = rows.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    values = {
        "text": F.col("text"),
        "n_chars": F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("doc.n_chars")),
    }
    return rows.select(*[values.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])


def _several(docs: DataFrame) -> DataFrame:
    """doc_id of ids that stand for different texts; texts are read only if an id repeats."""
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = written(again.select("doc_id"), "again")
    if not again.head(1):
        return again
    text = docs.select("doc_id", F.xxhash64("text").alias("text")).join(again, "doc_id", "left_semi")
    return text.groupBy("doc_id").agg((F.min("text") != F.max("text")).alias("several")).where("several").select("doc_id")


def _keyed(docs: DataFrame, many: DataFrame, taken: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with a ``key``, and what each key that is no id stands for (key, id, digest of the text, has words).

    The key is the id.  Rows without one, or with one of ``many``, get a number by id and text, which nothing else
    and no id of ``taken`` has.
    """
    own, mark = F.col("doc_id").cast("long"), _free(docs, "_mark")
    many = many.select(F.col("doc_id").alias(mark))
    if not many.head(1) and not docs.where(own.isNull()).head(1):
        none = many.select(F.col(mark).alias("key"), F.col(mark).alias("id"), F.lit("").alias("digest"), F.lit(True).alias("worded"))
        return docs.withColumn(key, own), none
    marked = docs.join(many, own == F.col(mark), "left")
    odd = own.isNull() | F.col(mark).isNotNull()
    digest = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("null"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    salt = 0
    while True:
        number = F.xxhash64(F.lit(salt), own, digest)
        named = marked.where(odd).select(number.alias("key"), own.alias("id"), digest.alias("digest"), worded.alias("worded"))
        named = written(named.distinct(), "odd")
        clash = named.count() > named.select("key").distinct().count()
        if not clash and not taken.join(named, F.col("doc_id") == F.col("key"), "left_semi").head(1):
            return marked.withColumn(key, F.when(odd, number).otherwise(own)).drop(mark), named
        salt += 1


def _near_copies(texts: DataFrame, among: DataFrame, odd: DataFrame) -> DataFrame:
    """Keys (doc_id) of the texts that a near copy stands for: the one of the smallest id, without an id the smallest key."""
    found = neardup.near_duplicates(texts, WIDTH, PERCENT, among).select("doc_id", "component_id").distinct()
    named = written(found, "near").join(odd.select(F.col("key").alias("doc_id"), "id", "digest"), "doc_id", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("id"))
    first = F.min(F.struct(own.isNull().alias("none"), own.alias("id"), "doc_id"))
    best = named.groupBy("component_id").agg(first["doc_id"].alias("best"))
    return written(named.join(best, "component_id").where("doc_id <> best").select("doc_id"), "gone")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest id, and one row of it.

    Near copies are decided twice.  First on whole texts as they stand in the table of documents, before lines were
    taken out of them: what line dedup leaves of a near copy is similar to little.  Then, among those that stay, on
    the texts as they came: without common lines, texts can be near copies that were not before.  Only documents that
    have come this far take part, so a group always keeps one of them.  A row without an id, one whose id stands for
    different texts (here or in the table), and one whose id the table doesn't have, is decided on the text it came
    with; with different texts under an id each is a document.  Rows without an id give way to those with one.  A
    null, empty or wordless text is a near copy of nothing and stays.  Rows equal in id and text are one row (without
    an id only if they have words).  Other columns stay, of that row.  An empty table gives no rows.
    """
    given, source = (
        t.select(F.col("doc_id").cast("long"), "text") for t in (docs, scan(spark, sf_dir, "documents"))
    )
    many = written(_several(given).union(_several(source)).distinct(), "many")
    ids = given.where("doc_id IS NOT NULL").select("doc_id").distinct()
    key = _free(docs, "_key")
    rows, odd = _keyed(docs, many, ids.union(source.select("doc_id")), key)
    ids = written(ids.join(many, "doc_id", "left_anti"), "ids")
    new = written(ids.join(source.select("doc_id"), "doc_id", "left_anti").union(odd.select("key")), "new")
    keys = written(ids.union(odd.select("key")), "keys")
    texts = rows.select(F.col(key).alias("doc_id"), "text")
    if new.head(1):
        source = source.unionByName(texts.join(new, "doc_id", "left_semi"))
    before = _near_copies(source, keys, odd)
    now = _near_copies(texts, keys.join(before, "doc_id", "left_anti"), odd)
    gone = written(before.union(now), "gone").select(F.col("doc_id").alias(key))
    again = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
    again = written(again.join(odd.where("id IS NULL AND NOT worded").select(F.col("key").alias(key)), key, "left_anti"), "again")
    kept = rows.join(gone, key, "left_anti")
    once = kept.join(again, key, "left_anti")
    return once.unionByName(kept.join(again, key, "left_semi").dropDuplicates([key])).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    Null, empty and short texts (under WIDTH words) hold none and stay, as do items that short or without text.
    Whole texts are searched.  Rows equal in id and text go or stay together, null ids too; other columns, whatever
    their names, stay.  Empty documents give no rows; an empty benchmark drops none.
    """
    found = decontaminate.contained_items(docs, scan(spark, sf_dir, "benchmark"), WIDTH, PERCENT)
    row = _free(docs, "_row")
    return docs.withColumn(row, _row()).join(
        found.select(F.col("row").alias(row)).distinct(), row, "left_anti"
    ).select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences.

    A null or empty text is one piece, its end mark.  Longer texts than a sequence are cut.  Repeated rows and null
    ids are documents of their own; an empty table gives no rows.
    """
    return packing.pack_pieces(written(packing.cut(docs, tokenizer_path()), "pieces"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained model and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
