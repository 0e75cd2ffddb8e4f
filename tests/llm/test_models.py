import collections
import math
import re
import zlib
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.llm import katz, langid, permindex, quality
from rillmark.llm.queries import op7_quality, op8_language, op9_permutation_search, op10_katz_scores

from .conftest import ODD, SF

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER)), None]


def good_turing(counter, k=5):
    """Katz's factors of counts 1 .. k by the textbook, with the module's rule where they aren't usable."""
    n = collections.Counter(counter.values())
    n1, n2 = n[1], n[2]
    absolute = {r: (r - min(n1 / (n1 + 2 * n2), 0.99)) / r if n1 else 1.0 for r in range(1, k + 1)}
    if any(not n[r] for r in range(1, k + 2)):
        return absolute
    out, tail = {}, (k + 1) * n[k + 1] / n1
    for r in range(1, k + 1):
        adjusted = (r + 1) * n[r + 1] / n[r]
        out[r] = (adjusted / r - tail) / (1 - tail) if tail < 1 else -1
    return out if all(0 < x <= 1 for x in out.values()) else absolute


def brute_katz(rows, modulus=7, remainder=2, order=3):
    """{doc_id: (held_out, n_tokens, n_known, N, base, score)}, P(w | history), and words and next words by history."""
    held = {i: zlib.crc32(str(i).encode()) % modulus == remainder for i, _ in rows}
    pad = [("start",)] * (order - 1)
    counts = [collections.Counter() for _ in range(order)]
    for i, text in rows:
        if not held[i]:
            t = [*pad, *tokens(text)]
            for k in range(order):
                counts[k].update(tuple(t[j - k : j + 1]) for j in range(len(pad), len(t)))
    factor = [good_turing(c) for c in counts]
    n, v = sum(counts[0].values()), len(counts[0])
    after = collections.defaultdict(dict)
    for c in counts[1:]:
        for gram, x in c.items():
            after[gram[:-1]][gram[-1]] = x
    freed = sum(x * (1 - factor[0].get(x, 1.0)) for x in counts[0].values()) / n if n else 0
    weights = {}

    def p(w, h):
        if not h:
            c = counts[0][(w,)]
            if not freed:
                return c / (n + 1) if c else 1 / (n + 1)
            return c * factor[0].get(c, 1.0) / n if c else freed
        seen, d = after.get(h), factor[len(h)]
        if not seen:
            return p(w, h[1:])
        if h not in weights:
            total = sum(seen.values())
            left = 1 - sum(c * d.get(c, 1.0) for c in seen.values()) / total
            if left <= 1e-12:
                total, left = total + 1, 1 / (total + 1)
            weights[h] = total, left / (1 - sum(p(x, h[1:]) for x in seen))
        total, alpha = weights[h]
        return seen[w] * d.get(seen[w], 1.0) / total if w in seen else alpha * p(w, h[1:])

    out = {}
    for i, text in rows:
        t = tokens(text)
        full = [*pad, *t]
        base = sum(math.log10((counts[0][(w,)] + 1) / (n + v + 1)) for w in t)
        score = sum(math.log10(p(full[j], tuple(full[j - order + 1 : j]))) for j in range(len(pad), len(full)))
        out[i] = held[i], len(t), sum(counts[0][(w,)] > 0 for w in t), n, base, score
    return out, p, counts[0], after


def same(got, want):
    assert set(got) == set(want)
    for i, r in got.items():
        assert tuple(r[1:5]) == want[i][:4]
        assert r.base_score == pytest.approx(want[i][4], abs=1e-6)
        assert r.score == pytest.approx(want[i][5], abs=1e-6)


@pytest.mark.parametrize(("order", "hot"), [(2, 20), (3, 20), (3, 1 << 18), (4, 50)])
def test_katz_against_brute_force(spark, docs, monkeypatch, order, hot):
    rows = [(r.doc_id, r.text) for r in docs.collect()][:60]
    want, p, one, after = brute_katz(rows, order=order)
    small = docs.where(F.col("doc_id").isin([i for i, _ in rows]))
    monkeypatch.setattr(katz, "BLOCK_BYTES", 1 << 14)
    monkeypatch.setattr(katz, "HOT", hot)  # some histories lie in several parts
    same({r.doc_id: r for r in katz.score(small, order=order, parts=5).collect()}, want)
    # each history's probabilities add up to one, the unseen word's included
    histories = [h for h in after if len(h) == order - 1]
    for h in [*histories[:3], *histories[-12:], (b"never seen",) * (order - 1), (b"never seen",) * (order - 2) + (b"the",)]:
        assert sum(p(w, h) for (w,) in one) + p(b"never seen", h) == pytest.approx(1, abs=1e-9)


def test_katz_odd(spark, odd, none):
    rows = {(r.doc_id, r.text) for r in odd.where("doc_id is not null and doc_id <> 6").collect()}
    same({r.doc_id: r for r in katz.score(odd.where("doc_id is not null and doc_id <> 6"), parts=3).collect()}, brute_katz(sorted(rows, key=str))[0])
    # rows without an id are scored by the same model, which isn't learnt from them
    every, known = katz.score(odd).collect(), {r.doc_id: r for r in katz.score(odd.where("doc_id is not null")).collect()}
    assert len(every) == odd.count() == len(ODD) + 2
    alone = [r for r in every if r.doc_id is None]
    assert [(r.held_out, r.train_tokens, r.n_tokens) for r in alone] == [(False, known[0].train_tokens, 8)]
    assert {r.doc_id: round(r.score, 9) for r in every if r.doc_id is not None} == {i: round(r.score, 9) for i, r in known.items()}
    assert katz.score(none).count() == 0
    nobody = katz.score(odd.where("doc_id = 1"), 1, 0).collect()
    assert [(r.train_tokens, r.n_tokens, r.score) for r in nobody] == [(0, 1, 0.0)]


def test_katz_counts_beyond_32_bits():
    """Two blocks ask for one bigram that each has met 2**33 times: everything stays whole and exact."""
    big = np.array([2**33, 1])
    one = {"bucket": 0, "keys": [7], "runs": [2], "words": [3, 9], "own": big, "held": [5, 0], "lower": [2**35, 2], "told": [1, *[0] * 11]}
    ask = {k: v if k == "bucket" else katz.packed(np.array(v)) for k, v in one.items()} | {"facts": None}
    told = katz.answer_order([ask | {"block": 1}, ask | {"block": 2}])
    assert [katz.unpacked(t[2]).tolist() for t in told] == [[2**34, 2]] * 2
    assert [katz.unpacked(t[3]).tolist() for t in told] == [[10, 0]] * 2
    # neither block knows the n-gram that the other one told of
    assert [katz.unpacked(t[4]).tolist() for t in told] == [[1]] * 2
    sums = katz.unpacked(told[0][5]).reshape(katz._SUMS, 1)[:, 0].tolist()
    assert sums == [2, 1, 0, 0, 0, 2**34, 0, 1, 0, 0, 0, 2**35]
    assert np.frombuffer(told[0][6], "<i8")[:2].tolist() == [2**34 + 2, 2]
    # a block that has met all of a unit needs no sums
    assert [katz.unpacked(t[4]).tolist() for t in katz.answer_order([ask | {"block": 1}])] == [[]]


@pytest.mark.parametrize("large", [[], [2**63, 2**63 + 1, 2**64 - 1]])
def test_distinct_numbers(large):
    """As np.unique() and a stable np.argsort() give them, also where numbers differ in their lowest bits alone."""
    values = np.array([*np.random.default_rng(1).integers(0, 300, 1000), *large, *large], np.uint64)
    want = np.unique(values, return_index=True, return_inverse=True)
    assert [x.tolist() for x in katz.distinct(values)] == [x.tolist() for x in want]
    assert katz.ordered(values).tolist() == np.argsort(values, kind="stable").tolist()
    assert [len(x) for x in katz.distinct(values[:0])] == [0, 0, 0]


def test_katz_histories_by_numbers():
    """A history of two words is asked for by their numbers, in 48 bits; by a hash only if these are large. The start isn't a word."""
    most = int(katz._NUMBERED)
    known, o = SimpleNamespace(number=np.array([0, 5, most, most - 1], np.uint64)), SimpleNamespace(hist=np.array([4, 0, 2, 1, 3]), word=np.array([1, 1, 0, 2, 3]))
    hashed = int(katz._HASHED)
    assert katz._Known._pairs(known, o).tolist() == [most << 24 | 5, 5, hashed, hashed, most - 1 << 24 | most - 1, hashed]


def test_packed_numbers():
    for x in ([], [0, 0], [0, 255, 256, 2**40, 2**64 - 1], [5]):
        got = katz.unpacked(katz.packed(np.array(x, np.uint64)))
        assert got.tolist() == (x if any(x) else [])


def test_packed_numbers_take_few_bits():
    """Numbers of which most are 0 take less than a bit each."""
    x = np.random.default_rng(1).choice(np.array([0, 0, 0, 0, 1, 2, 300], np.uint64), 40_000, p=[0.3, 0.3, 0.2, 0.1, 0.08, 0.015, 0.005])
    for values in (x, x[x > 0], x.reshape(100, -1), np.arange(20, dtype=np.uint64), np.uint64([0, 1, 2**64 - 1, 0, 0])):
        assert katz.unpacked(katz.packed(values)).tolist() == values.ravel().tolist()
    assert len(katz.packed(x)) < 40_000 * 0.75 / 8


def test_katz_tells_what_a_block_lacks():
    """Two blocks share a bigram; each is told the other's part of it and of its history alone."""
    one = {"bucket": 0, "keys": [7, 2], "runs": [2, 1], "words": [3, 9, 3], "own": [4, 0, 1], "held": [5, 1, 0], "lower": [20], "told": [1, *[0] * 23]}
    two = {"bucket": 0, "keys": [7], "runs": [1], "words": [9], "own": [2], "held": [0], "lower": [8], "told": [0] * 12}
    asks = [{k: v if k == "bucket" else katz.packed(np.array(v)) for k, v in x.items()} | {"facts": None, "block": b} for b, x in enumerate((one, two))]
    first, second = ([katz.unpacked(x).tolist() for x in t[2:6]] for t in katz.answer_order(asks, by_word=True, beside_own=True))
    # the first block has all that follows: its own, and with the count that it is told the other's bigram
    assert first == [[0, 2, 0], [], [], []]
    assert second == [[], [1], [1], [1, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 20]]
    whole = katz.answer_order([a | {"lower": katz.packed(np.array(x))} for a, x in zip(asks, ([20, 20], [8]), strict=True)])
    assert katz.unpacked(whole[1][2]).tolist() == [2] and katz.unpacked(whole[1][5]).tolist() == [1, 1, 0, 1, 0, 0, 0, 0, 0, 0, 0, 28]


def test_katz_beats_the_base(spark):
    held = op10_katz_scores(spark, SF).where("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert held[0] > held[1]


def test_discounts():
    d = katz.discounts(np.array([1000, 400, 200, 120, 80, 50]))
    assert ((d[1:6] > 0) & (d[1:6] < 1)).all()
    assert d[6] == 1
    assert (katz.discounts(np.array([3, 0, 0, 0, 0, 0]))[1:6] < 1).all()
    assert (katz.discounts(np.zeros(6)) == 1).all()


def test_language(spark, docs, odd, none):
    got = op8_language(spark, SF).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r.lang == r.lang_pred for r in got if r.held_out and r.lang]
    assert sum(held) / len(held) >= 0.95
    model = langid.fit(*langid.training_sample(docs, 3, 1))
    rows = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [rows[i].lang_pred == "und" for i in range(5)] == [True, True, True, True, False]
    assert rows[6][:5] == rows[6][:5]
    assert rows[6].lang_pred == rows[7].lang_pred
    assert langid.predict(odd, model).columns == [c for c in odd.columns if c != "score"] + ["lang_pred", "score"]
    assert langid.identify(odd).count() == odd.count()
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def coded(text):
    """The text's n-grams as the kernel sees them: letters in lower case, bytes from 128, and all others as one gap."""
    t = re.sub(rb"[^a-z\x80-\xff]", b" ", text.encode().translate(LOWER))
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def test_kernel_and_regression_against_brute_force():
    """Kernel matrix, Nyström features and ridge regression, from sets of n-grams and the dual solution."""
    r = np.random.default_rng(3)
    words = {"a": ["the", "and", "Of", "house", "wind"], "b": ["der", "und", "Haus", "straße", "wind"]}
    texts, langs = [], []
    for i in range(40):
        lang = "ab"[i % 2]
        texts.append(" ".join(r.choice(words[lang], r.integers(1, 12))) + "!?1 "[: i % 4])
        langs.append(lang)
    sets = [langid.gram_set(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    assert [len(s) for s in sets] == [len(coded(t)) for t in texts]
    model = langid.fit(sets, langs, 6)
    marks = [*range(0, 12)]
    k = lambda x, y: len(coded(x) & coded(y)) / math.sqrt(len(coded(x)) * len(coded(y)))
    order = marks  # the first six of each language, as they stand
    full = np.array([[k(t, texts[j]) for j in order] for t in texts])
    queries = [langid.grams(np.frombuffer(t.encode(), np.uint8)) for t in texts]
    assert np.abs(model.kernel(queries) - full).max() < 1e-5
    # the regression's solution in terms of landmarks: features times their transpose is the Nyström kernel
    own = full[order]
    phi = model.features(queries)[:, :-1].astype(float)
    assert np.abs(phi @ phi.T - full @ np.linalg.pinv(own, rcond=1e-6, hermitian=True) @ full.T).max() < 1e-2
    x = np.hstack((phi, np.ones((40, 1))))
    y = np.array([[1.0 if lang == c else -1.0 for c in "ab"] for lang in langs])
    dual = x @ x.T
    lam = langid.RIDGE * 40 / 100
    want = dual @ np.linalg.solve(dual + lam * np.eye(40), y)
    assert np.abs(model.scores(queries) - want).max() < 1e-2


def test_long_and_repeated_training_texts(spark):
    english, german = "the wind and the house of the river ", "der wind und das haus an dem fluss "
    rows = [(i, english * (1 + i % 3) + f"word{i}", "en") for i in range(60)]
    rows += [(100 + i, german * 900 + f" wort{i}", "de") for i in range(60)]  # about 30 kB each
    rows += [(500, "le vent et la maison du fleuve", "fr")] * 900  # one document, repeated
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sets, langs = langid.training_sample(df, 3, 1)
    assert langs.count("fr") == 1
    assert langs.count("de") == sum(zlib.crc32(str(100 + i).encode()) % 3 != 1 for i in range(60))
    got = langid.identify(df).distinct().join(df.distinct().select("doc_id", "lang"), "doc_id").collect()
    assert all(r.lang_pred == r.lang for r in got)
    assert len(langid.training_sample(df, 3, 1, 5)[0]) == 11


def test_quality(spark, docs, odd, none):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = quality.fit(big, labels, 200)
    known = labels.join(big.select("doc_id", F.col("text").alias("t")), "doc_id")
    scored = quality.score(big, model, ["doc_id"]).join(known, "doc_id").collect()
    good, bad = [r.kept for r in scored if r.quality == 1], [r.kept for r in scored if r.quality == 0]
    assert sum(good) / len(good) > 0.98
    assert sum(bad) / len(bad) < 0.3
    rows = quality.score(odd, model).collect()
    assert len(rows) == odd.count()
    assert all(not r.kept and r.quality_score == 0 for r in rows if not r.text)
    assert quality.score(none, model).count() == 0
    # too few labels, or of one class: their share for all
    one = quality.fit(odd, spark.createDataFrame([(6, 1, 0), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int"))
    assert len({r.quality_score for r in quality.score(odd, one).where("length(text) > 0").collect()}) == 1
    assert quality.score(docs.select("doc_id", "text"), model).count() == docs.count()
    assert op7_quality(spark, SF).count() == docs.count()


def test_co_training_labels_help():
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 400).astype(float)
    text, meta = np.zeros((400, quality._CONTENT)), np.zeros((400, quality._META))
    text[:, 0], meta[:, 0] = y * 2 - 1 + r.normal(0, 0.5, 400), y + r.normal(0, 0.2, 400)
    pool = lambda w, by: quality.pool_sums({"text": text[60:200], "meta": meta[60:200]}, w, by)
    m = quality.co_train(text[:60], meta[:60], y[:60], pool)
    p = m.probabilities(text[200:], meta[200:])[2]
    assert ((p > 0.5) == y[200:]).mean() > 0.95


def test_quality_against_brute_force(spark):
    """Held-out accuracy, and the distributed fit against one over arrays on the driver."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    learnt, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    model = quality.fit(docs, learnt, 500)
    rows = {r.doc_id: r for r in docs.collect()}
    view = lambda r: (quality.content(np.frombuffer((r.text or "").encode(), np.uint8)), quality.metadata([r.source], [r.lang], np.array([r.n_chars or 0]))[0])
    every = {i: view(r) for i, r in rows.items() if r.text}
    order = [r.doc_id for r in learnt.join(docs.where("length(text) > 0"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(500).collect()]
    y = {r.doc_id: float(r.quality) for r in learnt.collect()}
    assert len(set(order)) == len(order) == 500
    pool = [every[i] for i in every if i not in set(order)]
    pool = {"text": np.array([t for t, _ in pool]), "meta": np.array([m for _, m in pool])}
    want = quality.co_train(np.array([every[i][0] for i in order]), np.array([every[i][1] for i in order]), np.array([y[i] for i in order]), lambda w, by: quality.pool_sums(pool, w, by))
    for a, b in ((model.text, want.text), (model.meta, want.meta), (model.both, want.both)):
        assert np.abs(a - b).max() < 1e-3
    got = {r.doc_id: r for r in quality.score(docs, model, ["doc_id"]).collect()}
    truth = [(got[r.doc_id], r.quality) for r in held.collect() if r.doc_id in every]
    right = lambda f: np.mean([(f(g) >= 0.5) == bool(q) for g, q in truth])
    both, text, meta = right(lambda g: g.quality_score), right(lambda g: g.text_score), right(lambda g: g.meta_score)
    print("held-out accuracy: both", both, "text", text, "meta", meta)
    assert both >= 0.9 and both >= max(text, meta) - 0.01
    # as many of the pool as are sure take part
    sums = quality.distributed_pool(quality.stored_views(docs))({"text": model.text, "meta": model.meta}, {"text": model.text, "meta": model.meta})
    assert sum(n for n, _, _ in sums["meta"]) > 500


def test_quality_learns_from_long_texts(spark):
    """Labels on texts beyond 20 kB alone: junk and prose are still told apart."""
    rows = [(i, (f"A plain sentence about rivers and hills number {i}. " if i % 2 else f"$$ %% {i} ## @@ !! ") * 1200, "s", "en", 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = quality.score(df, quality.fit(df, labels)).where("doc_id >= 40").collect()
    assert all((r.quality_score >= 0.5) == bool(r.doc_id % 2) for r in got)


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        at = np.flatnonzero(ids == q)[0]
        s = x @ x[at]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), s[i]) for i in order]
    return out


def test_search_recall(spark):
    rows = op9_permutation_search(spark, "/root/testdata/sf0.01").collect()
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table])
    want = exact(ids, x, [i for i in ids.tolist() if i % 20 == 0], 20)
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    for q, found in got.items():
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
        at = {int(i): k for k, i in enumerate(ids)}
        assert all(s == pytest.approx(float(x[at[i]] @ x[at[q]]), abs=1e-12) for i, s in found)


def recall(df, ids, x, queries, k=20):
    """Share of the exact neighbours that the default search finds; its scores have to be those of brute force."""
    got = collections.defaultdict(dict)
    for r in permindex.search(df, F.col("vec_id").isin(queries), k).collect():
        got[r.query_id][r.vec_id] = r.score
    assert set(got) == set(queries) and all(len(found) == k for found in got.values())
    at, hits = {int(i): n for n, i in enumerate(ids)}, 0
    for q in queries:
        score = np.einsum("ij,j->i", x, x[at[q]])
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        hits += len(set(got[q]) & {int(ids[i]) for i in order})
        assert all(s == pytest.approx(score[at[i]], abs=1e-12) for i, s in got[q].items())
    return hits / (k * len(queries))


def frame(spark, ids, x):
    import pyarrow as pa

    return spark.createDataFrame(pa.table({"vec_id": pa.array(ids), "embedding": pa.array(list(x))}))


@pytest.mark.parametrize("hot", [False, True])
def test_search_recall_at_production_parameters(spark, monkeypatch, hot):
    monkeypatch.setattr(permindex, "VECTOR_BLOCK", 1024)  # so that the footrule leaves most of a block out
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    if hot:  # a third of the rows are copies of one vector
        x[ids % 3 == 0] = x[0]
    assert recall(frame(spark, ids, x), ids, x, [i for i in ids.tolist() if i % 20 == 0]) >= 0.95


def test_search_recall_of_many_random_vectors(spark):
    x = np.random.default_rng(7).normal(size=(100_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x))
    assert recall(frame(spark, ids, x), ids, x, [i for i in ids.tolist() if i % 1000 == 0]) >= 0.95


def test_footrule():
    r = np.random.default_rng(1)
    v, p = r.normal(size=(50, 8)), r.normal(size=(300, 8))
    place = permindex.places(v, p)
    for i in range(50):
        assert [int(place[i, k]) for k in np.argsort(-(p @ v[i]))] == list(range(300))
    want = np.abs(place.astype(int) - place[3]).sum(axis=1)
    assert permindex.footrule(np.ascontiguousarray(place.T), place[3]).tolist() == want.tolist()


def test_search_ids_with_several_vectors(spark):
    r = np.random.default_rng(5)
    rows = [(1, r.normal(size=4).tolist()) for _ in range(60)] + [(i, r.normal(size=4).tolist()) for i in range(2, 40)]
    rows += [(i, rows[60][1]) for i in (50, 51, 50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(x["rank"], x.vec_id) for x in permindex.search(df, F.col("vec_id") == 2, 10).collect()]
    q, best = np.array(rows[60][1]), {}
    for i, v in rows:
        best[i] = max(best.get(i, -np.inf), float(np.array(v) @ q))
    del best[2]
    want = sorted(best, key=lambda i: (-round(best[i], 9), i))[:10]
    assert sorted(got) == list(enumerate(want, 1))
    # a narrower search is approximate
    some = [x.vec_id for x in permindex.search(df, F.col("vec_id") == 2, 3, pivots=4, rerank=0.1).collect()]
    assert 0 < len(some) == len(set(some)) <= 3 and 2 not in some


def test_search_odd_vectors(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=6).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 0.0, 0.0, 9.0]) for i in range(40)]  # copies: the smaller ids come first
    rows += [(900, None), (920, [0.0] * 6), (940, [1.0, None, 1.0]), (960, [float("nan")] * 6), (980, [float("inf"), 1.0]), (1000, [5.0, 5.0]), (120, [1.0, 2.0, 3.0, 0.0, 0.0, 9.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "score": F.lit(2), "f": F.lit(3)})
    got = permindex.search(df, F.col("vec_id") % 20 == 0, 10, rerank=1.0).collect()
    found = collections.defaultdict(list)
    for x in sorted(got, key=lambda x: (x.query_id, x["rank"])):
        found[x.query_id].append(x.vec_id)
    assert set(found) == {0, 20, 40, 100, 120, 1000}
    assert found[100] == list(range(101, 111))
    assert all(len(v) == len(set(v)) == 10 for v in found.values())
    pad = {i: np.array(v + [0.0] * (6 - len(v))) for i, v in rows if i in range(200) or i == 1000}
    ids = np.array(sorted(pad))
    want = exact(ids, np.array([pad[i] for i in ids.tolist()]), sorted(found), 10)
    assert {q: v for q, v in found.items() if q != 120} == {q: [i for i, _ in v] for q, v in want.items() if q != 120}
    assert permindex.search(df.limit(0), F.lit(True)).count() == 0
    assert permindex.search(df.where("vec_id = 0"), F.lit(True)).count() == 0
    few = permindex.search(df.where("vec_id < 5"), F.col("vec_id") == 0, 20).collect()
    assert len(few) == 4
