"""Search, sharding, duplicates, decontamination and fixity against brute force, and their edge cases."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import compare, connect
from crosspanel.llm import decontaminate, fixity, linededup, neardup, sharding, vafile
from crosspanel.llm.queries import SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, SF), con, SQL[name]) in (None, "no rows")


def documents(spark, texts, ids=None):
    rows = [(i, t, "x", "y", "z") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, class string, key string")


def test_vector_search(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(400)]
    rows += [(500, None), (600, []), (700, [1.0, None]), (800, [float("nan")] * 8), (900, [float("inf")] * 8),
             (1000, [1.0] * 3), (1001, [2.0] * 3), (None, [1.0] * 8), (17, rows[17][1]), (100, rows[100][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    usable = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v in rows
              if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = set()
    for q, v in {i: v for i, v in usable if i % 100 == 0}.items():
        scores = sorted((-int(v @ w), i) for i, w in usable if i != q and len(w) == len(v))[:10]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)}
    for block in (8192, 37):
        got = vafile.top_k(table.where("vec_id % 100 = 0"), table, 10, block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert vafile.top_k(table.limit(0), table).count() == 0


def test_hypergeometric_law(spark):
    rows = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    k = sharding.hypergeometric(F.lit(7).cast("long"), F.lit(20).cast("long"), F.lit(9).cast("long"), F.col("u"))
    got = Counter(r[0] for r in rows.select(k).collect())
    from math import comb

    for x in range(8):
        want = comb(7, x) * comb(13, 9 - x) / comb(20, 9) if 9 - x <= 13 else 0
        assert abs(got[x] / 4000 - want) < 1e-3


def test_shards(spark):
    table = documents(spark, [None, "", "a"] + ["same"] * 2000 + [f"t{i}" for i in range(2000)], [i // 2 for i in range(4003)])
    rows = sharding.shuffle_to_shards(table, 8, partition_rows=64).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in rows) == Counter((r.doc_id, r.text) for r in table.collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert sorted(by) == list(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    # Uniform: the copies spread over all shards, and place doesn't follow the input's order.
    share = Counter(r.shard for r in rows if r.row.text == "same")
    assert all(abs(n - 250) < 75 for n in share.values())
    place = np.array([(r.row.doc_id, r.shard * 501 + r.slot) for r in rows])
    assert abs(np.corrcoef(place.T)[0, 1]) < 0.06
    assert sharding.shuffle_to_shards(table.limit(0), 8).count() == 0
    assert sharding.shuffle_to_shards(table.limit(3), 8).count() == 3


def test_matrix_sums(spark):
    counts = spark.createDataFrame([(p, 40 + p) for p in range(8)], "part long, n long")
    sizes = [60, 100, 188]
    rows = sharding.communication_matrix(counts, 3, sizes, 5).collect()
    assert {r.part: sum(r.sent) for r in rows} == {p: 40 + p for p in range(8)}
    assert np.array([r.sent for r in rows]).sum(axis=0).tolist() == sizes


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_components(texts, ids, width, percent):
    sets = [shingle_set(t, width) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)), key=lambda k: ids[k])
                up[b] = a
    return sets, [ids[min((k for k in range(len(ids)) if root(k) == root(i)), key=lambda k: ids[k])] for i in range(len(ids))]


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_near_duplicates(spark, width, percent, monkeypatch):
    rng = random.Random(width)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(90)]
    texts = [None, "", " \n", "One", "one", "Two words", "two  WORDS", "two words more"]
    for _ in range(140):  # a family around the threshold, with its exact copies
        copy = list(base)
        for _ in range(rng.randint(0, 7)):
            copy[rng.randrange(90)] = rng.choice(vocabulary)
        texts += [" ".join(copy)] * rng.choice([1, 1, 2])
    passage = " ".join(base[:40])
    texts += [f"{passage} {' '.join(rng.choice(vocabulary) for _ in range(60))}" for _ in range(40)]
    texts.append("word " * 50000)
    ids = rng.sample(range(10_000), len(texts))
    sets, want = brute_components(texts, ids, width, percent)
    for blocks in (2048, 16):
        monkeypatch.setattr(neardup, "BLOCK_CLASSES", blocks)
        got = {r.doc_id: r for r in neardup.near_duplicates(documents(spark, texts, ids), width, percent).collect()}
        assert {i: got[i].component_id for i in ids} == dict(zip(ids, want))
        assert all(got[i].n_shingles == len(s) and got[i].kept == (i == c) for i, s, c in zip(ids, sets, want))


def test_near_duplicate_edges(spark):
    rows = documents(spark, ["a b c d", "a b c d", "a b c d", None], [5, 5, None, None])
    got = neardup.near_duplicates(rows, 3, 85).collect()
    assert len(got) == 4 and Counter((r.doc_id, r.component_id, r.kept) for r in got)[(5, 5, True)] == 2
    assert neardup.near_duplicates(rows.limit(0), 3, 85).count() == 0


def test_miss_bounds():
    assert neardup.chunks_for(0.85) == 8 and neardup.chunks_for(0.8) <= 11
    assert neardup.most_errors(40, 0.85) >= 15


def test_components(spark):
    rng = random.Random(8)
    links = [(i, i + 1) for i in range(60)] + [(rng.randint(100, 300), rng.randint(100, 300)) for _ in range(90)]
    got = {r.node: r.component for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    up = {x: x for l in links for x in l}
    for _ in range(70):
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    assert got == {x: c for x, c in up.items() if any(x in l and l[0] != l[1] for l in links)}


def test_words_with_equal_upper_halves():
    """Two words whose hashes share 32 bits: a line's set hangs neither on their order nor on repeats."""
    a, b = "w71271", "w325183"
    from crosspanel.llm import words as W

    data, offsets = W.utf8(pa.array([f"{a} {b}"]))
    first, second = W.words(data, offsets)[0]
    assert first != second and first >> np.uint64(32) == second >> np.uint64(32)
    lines = [f"{a} {b} {a}", f"{a} {a} {b}", f"{b} {a} {b} {a}", f"{b} x {a} x {b}", f"x {a} {b} {a}"]
    for codes in (None, np.full(1 << linededup.COUNTER_BITS, 9, np.uint8)):
        flat, cuts, *_ = linededup.line_sets(*W.utf8(pa.array(lines)), codes)
        sets = [s.tolist() for s in np.split(flat, cuts[1:])]
        assert sets[0] == sets[1] == sets[2] and sets[3] == sets[4] and list(map(len, sets)) == [2, 2, 2, 3, 3]


def brute_lines(texts, percent, least):
    out, before = [], []
    for text in texts:
        kept = []
        for line in (text or "").split("\n"):
            words = frozenset(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), line)))
            if len(words) >= least:
                if any(100 * len(words & b) >= percent * len(words | b) for b in before):
                    before.append(words)
                    continue
                before.append(words)
            kept.append(line)
        out.append(None if text is None else "\n".join(kept))
    return out


def test_lines(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    texts = [None, "", "\n\n", "a b", "a b", "A  b c", "c b\ta\nx", "trailing line here\n"]
    stock = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(2, 25))) for _ in range(40)]
    for _ in range(120):
        lines = []
        for _ in range(rng.randint(0, 6)):
            words = rng.choice(stock).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(" ".join(words))
        texts.append("\n".join(lines))
    texts.append(" ".join(f"q{i}" for i in range(30000)))
    got = linededup.dedup_lines(documents(spark, texts)).collect()
    assert {r.doc.doc_id: r.text for r in got} == dict(enumerate(brute_lines(texts, 80, 1)))
    assert got[0].doc.row == "x"
    again = linededup.dedup_lines(documents(spark, ["k l m n\nother one here"] * 3, [1, 1, None])).collect()
    assert sorted((r.doc.doc_id or -1, r.text) for r in again) == [(-1, "k l m n\nother one here"), (1, ""), (1, "")]
    assert linededup.dedup_lines(documents(spark, [])).count() == 0


def test_short_lines(spark):
    rng = random.Random(16)
    vocabulary = [f"v{i}" for i in range(9)]
    texts = ["今日は天気がいいですね。\nmenu", "Menu\nmenu menu\n今日は天気がいいですね。", "a a a b\nb A", " \n\t\n", "x\n\nx"]
    texts += ["\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 7))) for _ in range(5)) for _ in range(150)]
    got = linededup.dedup_lines(documents(spark, texts), least=1).collect()
    assert {r.doc.doc_id: r.text for r in got} == dict(enumerate(brute_lines(texts, 80, 1)))


def test_short_sets_need_no_entry():
    for percent in (50, 80, 95):
        for n in range(1, 40):
            others = [(n, m, c) for m in range(1, 99) for c in range(min(n, m) + 1) if (n, m, c) != (n, n, n)]
            assert linededup.partnered(n, percent) == any(100 * c >= percent * (n + m - c) for n, m, c in others)
    texts = pa.record_batch({"row": [1], "doc_id": [1], "text": ["a b c\na b\na\na b c d\na"]})
    codes = np.full(1 << linededup.COUNTER_BITS, 9, np.uint8)
    (lines,) = linededup.line_batches([texts], codes, 80, 1)
    assert [len(p) for p in lines.column("prefix").to_pylist()] == [0, 0, 0, 1, 0]


def test_sweep_of_a_template(monkeypatch):
    """Lines of one template all match the first: their comparisons grow with their number, not its square."""
    calls, real = [], linededup._candidate
    monkeypatch.setattr(linededup, "_candidate", lambda a, b, p: calls.append(len(a["size"])) or real(a, b, p))
    n = 2000
    ids = np.arange(n)
    rows = {"word": ids * 0 + 7, "doc_id": ids[::-1].copy(), "line_no": ids * 0, "class": ids, "size": ids * 0 + 20,
            "pos": ids * 0, "even": np.where(ids % 3, 0, 3), "odd": ids * 0}
    y, x, count = linededup.sweep(rows, 80)
    assert sorted(y) == list(range(n - 1)) and set(x) == {n - 1} and sum(calls) < 4 * n
    assert dict(zip(y, count))[n - 2] == 1 and set(count) == {1, 2}


def test_sweep_finds_the_earliest():
    rng = np.random.default_rng(3)
    names = ("word", "doc_id", "line_no", "class", "size", "pos", "even", "odd")
    for n in (0, 1, 300):
        rows = dict(zip(names, (rng.integers(0, most, n) for most in (4, 50, 3, 90, 9, 3, 4, 2))))
        kind = rows["class"]
        rows |= {"size": 5 + kind % 4, "even": kind % 7, "odd": kind % 3}
        got = {}
        for y, x, c in zip(*linededup.sweep(rows, 80)):
            got.setdefault(int(y), []).append((int(x), int(c)))
        first = {}
        for i in sorted(range(n), key=lambda i: (rows["doc_id"][i], rows["line_no"][i], kind[i])):
            first.setdefault((int(rows["word"][i]), int(kind[i])), i)
        before, want = defaultdict(list), defaultdict(list)
        for (word, key), i in first.items():
            at = lambda j: {k: rows[k][j : j + 1] for k in names[4:]}
            found = [b for b, j in before[word] if linededup._candidate(at(j), at(i), 80)[0]]
            if found:
                want[key].append((found[0], min(2, len(found))))
            before[word].append((key, i))
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and (n < 300 or want)


def test_lines_in_doubt_are_settled_by_the_sweep(spark, monkeypatch):
    """Two earlier candidates that fail, then one that holds: the line isn't joined with all entries of its words."""
    tags, real = [], linededup.written
    monkeypatch.setattr(linededup, "written", lambda df, tag: tags.append(tag) or real(df, tag))
    rare = [f"r{i}" for i in range(5)]
    one, two, three = ([f"{k}{i}" for i in range(395)] for k in "abc")
    texts = [" ".join(rare + w) for w in (one, two, three, three[:380] + [f"y{i}" for i in range(15)])]
    texts.append("\n".join(w for w in one + two + three + texts[3].split()[-15:] for _ in range(10)))
    got = {r.doc.doc_id: r.text for r in linededup.dedup_lines(documents(spark, texts)).collect()}
    assert got == dict(enumerate(brute_lines(texts, 80, 1))) and got[3] == "" and got[2] == texts[2]
    assert "pairs" in tags and "entries" not in tags


def test_wanted_lines():
    texts = pa.array(["a b\nc\n\nd e", None, "", "\n", "f\ng"])
    ids, every = np.array([5, 6, 7, 8, -9]), np.full(1 << 12, 255, np.uint8)
    data, offsets = linededup.W.utf8(texts)
    lines = lambda table: [bytes(d[a:b]) for d, o in [linededup.wanted_lines(data, offsets, ids, table)] for a, b in zip(o, o[1:])]
    assert lines(every) == [b"a b", b"c", b"", b"d e", b"", b"", b"", b"", b"f", b"g"]
    assert lines(every * 0) == []


def test_prefix_lengths():
    for n in range(1, 200):
        assert linededup.probe_length(n, 80) == n - -(-80 * n // 100) + 1
        assert linededup.index_length(n, 80) == n - -(-160 * n // 180) + 1


def test_contained_items(spark):
    rng = random.Random(7)
    vocabulary = [f"u{i}" for i in range(3000)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 70))] for _ in range(60)]
    texts = [None, "", "too few words"]
    for i, item in enumerate(items):
        inside = list(item)
        for _ in range(i % 4):
            inside[rng.randrange(len(inside))] = "changed"
        around = [rng.choice(vocabulary) for _ in range(rng.choice([0, 5, 4000]))]
        texts.append(", ".join([*around, *inside, *around[:3]]).upper())
    table = spark.createDataFrame(
        [(i, " ".join(t)) for i, t in enumerate(items)] + [(98, None), (99, "a"), (0, " ".join(items[0])), (None, " ".join(items[9]))],
        "item_id long, text string",
    )
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = set()
    for d, text in enumerate(texts):
        have = sets(re.findall("[a-z0-9]+", (text or "").lower()))
        for i, item in [*enumerate(items), (None, items[9])]:
            need = sets(item)
            if need and 100 * len(need & have) >= 80 * len(need):
                want.add((d, i, len(need & have), len(need)))
    rows = documents(spark, texts)
    got = decontaminate.contained_items(rows.union(rows), table).select("doc_id", "item_id", "shared", "n").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) and len(want) > 20
    assert decontaminate.contained_items(rows, table.limit(0)).count() == 0
    assert decontaminate.contained_items(rows.limit(0), table).count() == 0


def test_fixity(spark):
    rng = random.Random(11)
    one = [(a, o * 997, 997, f"{a}-{o}", "m") for a in range(3) for o in range(300)]
    two = list(one)
    planted = {}
    for i in rng.sample(range(len(one)), 12):
        a, o, n, d, _ = one[i]
        kind = rng.choice(["changed", "missing"])
        planted[(a, o)] = kind
        two[i] = (a, o, n, d + "!", "m") if kind == "changed" else None
    two = [t for t in two if t] + [(7, 5, 10, "new", "m"), (None, 1, 1, "x", "m")]
    planted[(7, 5)] = "extra"
    schema = "archive long, offset long, length long, digest string, node string"
    tables = [spark.createDataFrame(t, schema) for t in (one, two)]
    got = fixity.audit(*tables, range_bytes=2000, fanout=4).collect()
    assert {(r.archive, r.offset): r.kind for r in got} == planted and len(got) == len(planted)
    assert fixity.audit(tables[0], tables[0]).count() == 0
    assert fixity.audit(tables[0].limit(0), tables[0].limit(0)).count() == 0
    assert fixity.audit(tables[0], tables[0].limit(0)).where("kind = 'missing'").count() == 900


def test_layout_has_every_byte(spark):
    pages = spark.createDataFrame([(1, "u", "<p>é</p>"), (2, None, None), (None, "v", ""), (300, "w", "x")], "page_id long, url string, html string")
    rows = fixity.layout(pages).orderBy("archive", "offset").collect()
    assert [(r.archive, r.offset) for r in rows] == [(-1, 0), (0, 0), (0, rows[1].length), (1, 0)]
    assert len(pages.select(fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).where("page_id = 1").first().r.encode()) == rows[1].length


def test_sizes_are_utf8(spark):
    rows = {r.doc_id: r for r in entry.queries()["op10_exact_shuffle"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = (r.text or "").encode()
        assert rows[r.doc_id].size == len(raw) + 1 and rows[r.doc_id].text_crc32 == zlib.crc32(raw)
