"""Locally consistent parsing against a plain version, and what fingerprints promise."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillmark.llm import parsing
from rillmark.llm.common import flat, mixed
from rillmark.llm.queries import queries

SF = "/root/testdata/sf0.001"
M = (1 << 64) - 1


def mix(h):
    return int(mixed(np.array([h & M], np.uint64))[0])


def plain_colours(names):
    label = list(names)
    for _ in range(4 if max(label) > 255 else 3):
        new = []
        for i, x in enumerate(label):
            d = x ^ label[i - 1] if i else 1
            bit = (d & -d).bit_length() - 1
            new.append(2 * bit + (x >> bit & 1))
        label = new
    for c in (3, 4, 5):
        old = list(label)
        for i, x in enumerate(old):
            if x == c:
                near = {old[j] for j in (i - 1, i + 1) if 0 <= j < len(old)}
                label[i] = min({0, 1, 2} - near)
    return label


def plain_level(names, level):
    """The phrases of one level as (name, names of the level below)."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    n = len(runs)
    cuts = [0]
    if n > 1:
        c = plain_colours([r[0] for r in runs])
        top = [0 < i < n - 1 and c[i] > c[i - 1] and c[i] > c[i + 1] for i in range(n)]
        low = [0 < i < n - 1 and c[i] < c[i - 1] and c[i] < c[i + 1] for i in range(n)]
        marks = [top[i] or (low[i] and not top[i - 1] and not top[i + 1]) for i in range(n)]
        cuts += [i for i in range(2, n - 1) if marks[i]]
    value = (lambda x: mix(1000 + x)) if level == 1 else (lambda x: x)
    odd = [mix(k + 1) | 1 for k in range(16)]
    out = []
    for a, b in zip(cuts, [*cuts[1:], n], strict=True):
        out.append((mix(sum(value(x) * (2 * r - 1) * odd[k] for k, (x, r) in enumerate(runs[a:b]))), sum(r for _, r in runs[a:b])))
    return out


def plain_sketch(text):
    names, features, level = list(text.encode()), set(), 0
    while names:
        level += 1
        names = [x for x, _ in plain_level(names, level)]
        if level >= parsing.LEVEL or len(names) == 1:
            features |= {mix(x + level) for x in names}
        if len(names) == 1:
            break
    bins = [0] * parsing.BINS
    for b in range(parsing.BINS):
        inside = [h for h in features if h >> 57 == b]
        if inside:
            bins[b] = 1 + mix(min(inside)) % 255
    return bytes(bins)


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(3)
    made = ["", "a", "ab", "aa", "aaaa", "abab" * 9, "hello world", "é x́ 日本 \U0001f642", "x" * 500, "the same " * 40]
    for n in (3, 7, 40, 300, 3000):
        made += ["".join(r.choice(list("abcdefgh \n"), n)) for _ in range(3)]
        made += ["".join(r.choice(list("ab"), n)) for _ in range(2)]
    return made


def test_against_plain_version(texts):
    got = parsing.sketches(*flat(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        assert row.tobytes() == plain_sketch(t), t[:50]


def test_windows_change_nothing(texts, monkeypatch):
    whole = parsing.sketches(*flat(pa.array(texts)))
    monkeypatch.setattr(parsing, "WINDOW", 37)
    assert (parsing.sketches(*flat(pa.array(texts))) == whole).all()


def test_colours_and_phrases(texts):
    data, offsets = flat(pa.array(texts))
    for t in texts:
        runs = np.array([c for i, c in enumerate(t.encode()) if not i or t.encode()[i - 1] != c], np.uint8)
        if len(runs):
            c = parsing.colours(runs, np.array([0]))
            assert c.max() <= 2 and (c[1:] != c[:-1]).all()
    names, starts, at = parsing.parse(data, offsets)
    size, had = np.diff(starts), np.diff(offsets)
    assert ((size > 0) == (had > 0)).all() and (size <= np.maximum(1, had // 2)).all()
    assert len(names) == len(at) == starts[-1]


def test_equal_substrings_share_inner_phrases(spark):
    r = np.random.default_rng(5)
    word = lambda n: "".join(r.choice(list("abcdefghijklmnop "), n))
    inner = word(2000)
    rows = [(k, word(k * 13) + inner + word(100 - k)) for k in range(1, 9)]
    found = parsing.phrases(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    lead = {k: k * 13 for k, _ in rows}
    for level, margin in ((3, 60), (4, 150), (5, 400)):
        sets = []
        for k, _ in rows:
            mine = {(p.start - lead[k], p.name) for p in found if p.doc_id == k and p.level == level}
            sets.append({x for x in mine if margin <= x[0] <= 2000 - 2 * margin})
        assert len(sets[0]) >= 5 and all(s == sets[0] for s in sets)


def test_likeness():
    r = np.random.default_rng(6)
    word = lambda n: "".join(r.choice(list("abcdefghijklmnop "), n))
    for _ in range(5):
        a, b, c = word(4000), word(4000), word(2000)
        made = parsing.sketches(*flat(pa.array([a, b, a[:2000] + c, a, a[:1990] + "xyz" + a[1990:]])))
        near = lambda i, j: float(parsing.likenesses(made[i : i + 1], made[j : j + 1])[0])
        assert near(0, 3) == 1 and near(0, 1) < 0.05 and near(0, 4) > 0.85
        assert abs(near(0, 2) - 1 / 3) < 0.2  # a half is common, of three


def test_likeness_column(spark, texts):
    rows = [(i, t, u) for i, (t, u) in enumerate(zip(texts, texts[1:] + texts[:1], strict=True))] + [(99, "", ""), (98, "same", "same")]
    df = parsing.fingerprints(parsing.fingerprints(spark.createDataFrame(rows, "i int, t string, u string"), "t", "f"), "u", "g")
    for x in df.withColumn("near", parsing.likeness(F.col("f"), F.col("g"))).collect():
        a, b = (np.frombuffer(bytes.fromhex(v), np.uint8)[None, :] for v in (x.f, x.g))
        assert x.near == pytest.approx(float(parsing.likenesses(a, b)[0]))


def expected(rows):
    """By doc_id of distinct ids: n_chars, edited_sha256, fingerprint, edited_fingerprint."""
    ring = sorted(rows, key=lambda x: -x[0])
    out = {}
    for (i, t), (_, f) in zip(ring, ring[1:] + ring[:1], strict=True):
        t, f = t or "", f or ""
        e = t[: len(t) - len(t) // 2] + f[: len(t) // 2]
        out[i] = len(t), hashlib.sha256(e.encode()).hexdigest(), e, f
    return out


def holds(df, rows):
    want = expected(rows)
    texts = sorted({t or "" for _, t in rows} | {e for _, _, e, _ in want.values()})
    sketch = dict(zip(texts, parsing.sketches(*flat(pa.array(texts))), strict=True))
    own = {i: t or "" for i, t in rows}
    got = df.collect()
    assert sorted(r.doc_id for r in got) == sorted(want)
    for r in got:
        n, sha, e, f = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert r.fingerprint == sketch[own[r.doc_id]].tobytes().hex() and r.edited_fingerprint == sketch[e].tobytes().hex()
        for near, other in ((r.near_edited, e), (r.near_next, f)):
            assert near == pytest.approx(float(parsing.likenesses(sketch[own[r.doc_id]][None, :], sketch[other][None, :])[0]))
            assert 0 <= near <= 1


def test_query(spark, docs):
    df = queries()["op11_parsed_fingerprints"](spark, SF)
    holds(df, [(r.doc_id, r.text) for r in docs.collect()])
    near = df.where("n_chars > 400").agg(F.avg("near_edited"), F.avg("near_next")).head()
    assert near[0] > near[1] + 0.15


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_small_tables(spark, parts):
    for rows in ([(5, "only one here")], [(1, "ab" * 30), (9, None)], [(i, "some words " * i) for i in range(30)]):
        holds(parsing.edit_probe(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)), rows)


def test_odd_tables(spark, odd, none):
    got = parsing.edit_probe(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 1
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    assert parsing.edit_probe(none).collect() == []
    made = parsing.fingerprints(odd.withColumn("fingerprint", F.lit(1)).withColumn("row", F.lit(2)).withColumn("f", F.lit(3)))
    assert sorted(made.columns) == sorted([*odd.columns, "fingerprint", "row", "f"]) and made.count() == odd.count()
    assert parsing.fingerprints(none).collect() == [] and parsing.phrases(none).collect() == []
    assert all(len(r.fingerprint) == 2 * parsing.BINS for r in made.select("fingerprint").collect())


def test_repeated_rows_are_several_tasks(spark):
    rows = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one text of many rows").alias("text"))
    dealt = rows.repartitionByRange(4, F.col("doc_id").desc_nulls_last(), F.xxhash64("text"), F.monotonically_increasing_id())
    assert max(r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()) < 2000
    assert {(r.near_next, r.near_edited) for r in parsing.edit_probe(rows).select("near_next", "near_edited").distinct().collect()} != set()
    assert parsing.edit_probe(rows).count() == 4000
