"""Every stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F
from test_set_operators import brute_components, brute_lines
from test_text_operators import check_packed

import corpus_pipeline as pipeline
from crosspanel.llm import toxicity

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(df.collect(), key=lambda r: (r.doc_id is None, r.doc_id))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    source = {r.doc_id: r.text for r in docs.collect()}
    # Edge rows: no text, empty text, a repeated row, a row without an id.
    first = docs.orderBy("doc_id").first()
    extra = [(90001, None), (90002, ""), (first.doc_id, first.text), (None, "a row without an id at all"), (90003, "w " * 20000)]
    docs = docs.unionByName(spark.createDataFrame(
        [(i, t, "en", "src", len(t or "")) for i, t in extra], docs.schema
    ))
    columns = docs.columns
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    fives = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)}
    for name, stage in pipeline.STAGES:
        before = rows(docs)
        out = stage(spark, docs, SF)
        after = rows(out)
        texts = [r.text for r in before]
        if name == "toxicity":
            labels = toxicity.learnable(spark.read.parquet(f"{SF}/labels.parquet"), "toxic", 4, 2)
            scored = toxicity.score(docs, toxicity.train(docs, labels)).collect()
            assert after == sorted((r[:-1] for r in scored if r.score < 0.3), key=lambda r: (r[0] is None, r[0]))
            assert len(after) < len(before)
        elif name == "line_dedup":
            order = sorted(range(len(before)), key=lambda i: (before[i].doc_id is not None, before[i].doc_id))
            # Repeated rows are one document.
            once = [i for k, i in enumerate(order) if not k or before[i][:2] != before[order[k - 1]][:2]]
            cleaned = dict(zip([before[i].doc_id for i in once], brute_lines([texts[i] for i in once], 80, 1)))
            want = [(r.doc_id, cleaned[r.doc_id]) for r in before
                    if cleaned[r.doc_id] == r.text or re.search(r"[^\x20\x09-\x0D]", cleaned[r.doc_id])]
            assert [(r.doc_id, r.text) for r in after] == want
            assert all(r.n_chars == len(r.text or "") for r in after)
        elif name == "near_dedup":
            known = [i for i, r in enumerate(before) if r.doc_id is not None]
            # Decided on the texts before line dedup.
            given = [source.get(before[i].doc_id, texts[i]) for i in known]
            _, component = brute_components(given, [before[i].doc_id for i in known], 5, 80)
            want = sorted({before[i].doc_id for i, c in zip(known, component) if before[i].doc_id == c})
            assert [r.doc_id for r in after] == want + [None] * (len(before) - len(known))
        elif name == "decontamination":
            need = [fives(t) for t in items]
            held = lambda t: any(n and 100 * len(n & fives(t)) >= 80 * len(n) for n in need)
            assert after == [r for r in before if not held(r.text)] and len(after) < len(before)
        else:
            ids = {r.doc_id: i for i, r in enumerate(before)}
            place = [r.asDict() | {"doc_id": ids[r.doc_id]} for r in out.collect()]
            check_packed([type("Piece", (), p) for p in place], texts, 1024)
            assert {r.doc_id for r in after} == set(ids)
            continue
        assert out.columns == columns
        docs = spark.createDataFrame(after, docs.schema)
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_no_copy_leaves_line_dedup_with_words(spark):
    """Every line with a word takes part, so an exact copy of an earlier document goes whole."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = rows(docs)
    texts = [r.text for r in before]
    after = {r.doc_id: r.text for r in pipeline.drop_lines(spark, docs, SF).collect()}
    cleaned = dict(zip([r.doc_id for r in before], brute_lines(texts, 80, 1)))
    has_words = lambda t: re.search(r"[^\x20\x09-\x0D]", t or "")
    assert after == {r.doc_id: cleaned[r.doc_id] for r in before if cleaned[r.doc_id] == r.text or has_words(cleaned[r.doc_id])}
    copies = [r.doc_id for i, r in enumerate(before) if has_words(r.text) and r.text in texts[:i]]
    assert copies and not set(copies) & set(after)


def test_edited_copies_go_after_line_dedup(spark, tmp_path):
    """A copy with edited words keeps only its edited lines in line dedup; near dedup still takes it for a copy."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    plain = [[[word() for _ in range(12)] for _ in range(12)] for _ in range(30)]
    edited = [[list(line) for line in doc] for doc in plain[:20]]
    for doc in edited:
        doc[3][1], doc[3][5], doc[3][9] = word(), word(), word()
    text = lambda doc: "\n".join(" ".join(line) for line in doc)
    given = [(i, text(d), "en", "s", len(text(d))) for i, d in enumerate(plain + edited)]
    # An empty one, and a copy of one that isn't among the rows which come this far.
    given += [(100, "", "en", "s", 0), (101, None, "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(given, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").where("doc_id <> 7")
    lines = pipeline.drop_lines(spark, docs, str(tmp_path))
    left = {r.doc_id: r.text for r in lines.collect()}
    assert all(len(left[30 + i].split("\n")) == 1 for i in range(20) if i != 7) and len(left[37].split("\n")) == 12
    kept = sorted(r.doc_id for r in pipeline.drop_near_duplicates(spark, lines, str(tmp_path)).collect())
    assert kept == [i for i in range(30) if i != 7] + [37, 100, 101]


def test_near_dedup_takes_every_row_and_text(spark, tmp_path):
    """Rows without an id, different texts under one id, and near copies only in the texts as they come take part."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    plain = [[word() for _ in range(60)] for _ in range(9)]
    text = lambda i, at=12: "\n".join(" ".join(plain[i][k : k + at]) for k in range(0, 60, at))
    near = lambda i: text(i).replace(plain[i][30], "edited")
    common = [" ".join(word() for _ in range(150)) for _ in range(2)]
    # Ids 1 and 2 are near copies without their other lines only; 4 stands for two texts, one a near copy of 3.
    table = [(0, text(0)), (1, common[0] + "\n" + text(1)), (2, common[1] + "\n" + text(1, 20)), (3, text(3)), (4, near(3)), (4, text(4))]
    table += [(None, near(0)), (None, text(5)), (None, near(5)), (None, text(6)), (None, ""), (None, "")]
    schema = "doc_id long, text string"
    spark.createDataFrame(table, schema).write.parquet(f"{tmp_path}/documents.parquet")
    came = [(i, {1: text(1), 2: text(1, 20)}.get(i, t)) for i, t in table] + [(4, text(4)), (-7, near(4)), (9, text(6))]
    out = pipeline.drop_near_duplicates(spark, spark.createDataFrame(came, schema), str(tmp_path))
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in out.collect()))
    left = [t for none, _, t in kept if none]
    assert [(i, t) for none, i, t in kept if not none] == [(-7, near(4)), (0, text(0)), (1, text(1)), (3, text(3)), (9, text(6))]
    assert left[:2] == ["", ""] and len(left) == 3 and left[2] in (text(5), near(5))
    # Different texts under one id that are no copies stay, each once.
    out = pipeline.drop_near_duplicates(spark, spark.createDataFrame([(4, text(7)), (4, text(8)), (4, text(8))], schema), str(tmp_path))
    assert sorted(r.text for r in out.collect()) == sorted([text(7), text(8)])


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Working columns give way to a user's, and those come out as they went in."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.withColumns({"_row": F.col("doc_id") + 7, "_toxicity": F.lit("mine"), "row": F.lit(1), "class": F.lit("c")})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = out.select("doc_id", "_row", "_toxicity", "row", "class").collect()
        assert got and all(r == (r.doc_id, r.doc_id + 7, "mine", 1, "c") for r in got), name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
