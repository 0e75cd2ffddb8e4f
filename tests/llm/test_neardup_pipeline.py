import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rillmark.llm import neardup
from rillmark.llm.common import flat, marked, shingles, words
from rillmark.llm.neardup import near_duplicates

from .conftest import SF

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def sets(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """{doc_id: (n_shingles, component_id)} of rows (doc_id, text), all pairs."""
    s = {i: sets(t) for i, t in rows}
    parent = {i: i for i in s}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(s[a] & s[b])
            if both and 100 * both >= 75 * (len(s[a]) + len(s[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s[i]), root(i)) for i in ids}


def check(df):
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").where("doc_id is not null").collect()]
    want = brute(rows)
    got = near_duplicates(df).where("doc_id is not null").collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_tables(spark, docs):
    check(docs)


def test_odd(odd, none):
    check(odd)
    assert [(r.component_id, r.kept) for r in near_duplicates(odd).where("doc_id is null").collect()] == [(None, True)]
    assert near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [8, 512])
def test_large_group_of_near_copies(spark, monkeypatch, block):
    """Copies with some words changed: similarities lie on both sides of the limit."""
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", block)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", block)
    r = np.random.default_rng(block)
    base = [f"w{r.integers(500)}" for _ in range(80)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in r.choice(80, r.integers(0, 6), False):
            w[k] = f"z{r.integers(10**6)}"
        rows.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    rows += [(1000 + i, " ".join(base[:4])) for i in range(5)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_chain_in_a_large_family(spark, monkeypatch):
    """Many near copies over several blocks, and a chain of texts of which each is linked with the next alone."""
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 32)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 16)
    r = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        w[int(r.integers(200))] = f"z{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[i * 10 : i * 10 + 110])) for i in range(9)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_one_document_of_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (3, b), (7, a + " more"), (8, c), (8, ""), (2, c), (9, None), (9, ""), (1, "x y")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(5, 3, False), (3, 3, True), (7, 3, False), (8, 2, False), (2, 2, True), (9, 9, True), (1, 1, True)}
    assert len(got) == len(rows)


def test_repeated_rows_are_one_in_cells(spark, monkeypatch):
    """Rows of one document and text don't fill a cell, however many; the document's other text and its copies are linked."""
    sizes = spark.sparkContext.accumulator(0)
    whole = neardup.spread_links

    def counting(ids, linked):
        sizes.add(len(ids))
        return whole(ids, linked)

    monkeypatch.setattr(neardup, "spread_links", counting)
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(5, a)] * 3000 + [(5, b), (7, a + " more"), (3, b + " more")] + [(6, a.upper())] * 50
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == {(5, 3), (7, 3), (3, 3), (6, 3)}
    assert 0 < sizes.value < 300


def test_parts_of_a_large_family_meet(monkeypatch, spark):
    """Two kinds of texts in one bucket-made family, linked by one member of a small part: rows dealt grow with members."""
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 8)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 8)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base + [f"z{i}"])) for i in range(100)]
    rows += [(500 + i, " ".join(base[4 * i :] + [f"y{i}x{k}" for k in range(4 * i)])) for i in range(8)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_boundary(spark):
    # 12 and 16 shingles, 12 in common: exactly 0.75; and one less
    w = [f"t{i}" for i in range(20)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:16])), (3, " ".join(f"u{i}" for i in range(20))), (4, " ".join(f"u{i}" for i in range(15)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_words_and_shingles():
    import pyarrow as pa

    texts = ["", None, "A b", " a  B ", "a b c d e f", "x\x0by\x1cz", "a b c d e", "\xa0  "]
    h, at = words(*flat(pa.array(texts)))
    assert np.diff(at).tolist() == [0, 0, 2, 2, 6, 2, 5, 2]
    assert (h[at[2] : at[3]] == h[at[3] : at[4]]).all()
    s, cut = shingles(h, at)
    assert np.diff(cut).tolist() == [0, 0, 1, 1, 2, 1, 1, 1]
    assert s[cut[2]] == s[cut[3]]
    assert s[cut[4]] == s[cut[6]]


def test_estimate():
    r = np.random.default_rng(2)
    for share in (0.3, 0.75, 0.95):
        a = r.integers(0, 2**63, 2000, dtype=np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        b = np.concatenate((a[:n], r.integers(0, 2**63, 2000 - n, dtype=np.uint64)))
        low = neardup.minima(np.concatenate((a, b)), np.array([0, 2000, 4000]))
        sig = neardup.packed(low)
        assert neardup.similarity(sig[0], sig[1:])[0] == pytest.approx(n / (4000 - n), abs=0.17)


def test_pipeline(spark, docs):
    now = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
        seen[name] = now
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == docs.columns
    kept = near_duplicates(seen["quality_classifier"]).where("kept")
    assert {r.doc_id for r in seen["near_dedup"].collect()} == {r.doc_id for r in kept.collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in seen["near_dedup"].collect()}


def test_pipeline_keeps_one_row_of_a_document(spark, docs):
    """Whatever the order of the rows: the least one."""
    text = docs.where("length(text) > 400").limit(3).collect()
    rows = [(70, r.text, r.lang, r.source, r.n_chars) for r in text] + [(71, text[0].text, "en", "s", 5)] * 2 + [(None, "a b c", "en", "s", 1)] * 2
    df = spark.createDataFrame(rows, docs.schema)
    want = None
    for order in (rows, rows[::-1]):
        got = sorted(map(tuple, corpus_pipeline.near_dedup(spark, spark.createDataFrame(order, docs.schema).repartition(3), SF).collect()), key=str)
        assert want is None or got == want
        want = got
    assert [r[0] for r in want].count(70) == 1 and [r[0] for r in want].count(None) == 2
    assert df.count() == 7


def test_pipeline_bears_odd_rows(spark, odd, none):
    for df in (odd, none):
        now = df
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        now.collect()
    assert corpus_pipeline.language_id(spark, odd, SF).where("text is null or length(trim(text)) = 0").count() == 0
    assert F is not None


def test_pipeline_carries_all_columns(spark, docs):
    """Columns that are named as what stages add, and of kinds without an order, come out as they went in."""
    names = ["score", "lang_pred", "kept", "quality_score", "text_score", "meta_score", "_source", "_lang", "_doc_id", "_n_chars", "_text", "n", "_r", "_id", "component_id", "a.b", "carried column 7"]
    rows = docs.limit(60).unionByName(docs.limit(5))
    wide = rows.withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in names}).withColumn("facts", F.create_map(F.lit("id"), "doc_id"))
    now = wide.persist()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.dtypes == wide.dtypes
        now = now.persist()
    got = now.collect()
    assert got
    for r in got:
        assert r["facts"] == {"id": r["doc_id"]} and all(r[c] == f"{c} {r['doc_id']}" for c in names)
    plain = rows
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, plain, SF)
    assert sorted(r.doc_id for r in plain.collect()) == sorted(r["doc_id"] for r in got)


def test_few_others_are_marked(spark, docs):
    """All ids that are looked for, whatever their sign or kind, and few others: only such rows' texts are dealt."""
    ids = spark.range(-30_000, 30_000, 7).toDF("doc_id")
    rows = spark.range(-30_000, 30_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("a.b")).union(spark.sql("SELECT NULL, 'x'"))
    got = marked(rows, ids)
    assert got.columns == ["doc_id", "a.b", "_may"] and got.count() == 60_001
    may = {r.doc_id for r in got.where("_may").collect()}
    assert may >= set(range(-30_000, 30_000, 7)) and len(may) < 60_000 * (1 / 7 + 0.1)
    assert marked(rows, ids.limit(0)).where("_may").count() == 0
    load = neardup.whole_texts(docs, docs.where("doc_id < 3").select("doc_id"), False, "doc_id", "text")
    every = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.lit(False).alias("repeated"))
    assert {0, 1, 2} & {r.doc_id for r in docs.collect()} <= {r.doc_id for r in load(every).collect()} and load(every).count() < docs.count() / 2
