"""Quality classification by co-training.

Two views of a document, each with its own logistic regression: the text's content (frequencies of
pairs of byte classes, repeated lines, word shape) and the metadata (source, language, length). In each
round a view learns from the labelled rows and from all unlabelled documents that the other view is sure
of. Those stay where they are: each partition sums up what a Newton step needs of them, a matrix of fixed
size, so their number has no bound. Both views are then calibrated on labelled rows kept aside, and a last
regression of the two calibrated views scores every document.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import flat, pieces, small_batches, stored

#: Labelled documents that are fitted at most. Texts have any length, and all documents without one of these labels are the pool.
LABELLED = 3000
#: Rounds, Newton steps of a round, the logit from which a view is sure, and what the sure documents weigh together against the labelled ones.
ROUNDS, STEPS, SURE, POOL_WEIGHT = 3, 2, 2.2, 0.5
#: Documents whose probability of good quality is lower are rejected.
REJECT_BELOW = 0.35

# byte classes: a-z, A-Z, 0-9, bytes from 128, space, newline, and kinds of marks
_CLASS = np.full(256, 6, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
for _k, _chars in enumerate((b".,;:", b"!?", b"|", b"*#&%$", b"@/\\_=+", b"<>{}[]()", b"-'\"", b"~^`")):
    _CLASS[list(_chars)] = 7 + _k
_CONTENT = 256 + 6
_SOURCES, _LANGS, _LENGTHS = 64, 32, 24
_META = _SOURCES + _LANGS + _LENGTHS
#: Places of a metadata view that are 1.
_ONES = 3


def content(data: np.ndarray) -> np.ndarray:
    """The content view of one text's bytes."""
    out = np.zeros(_CONTENT, np.float32)
    if not len(data):
        return out
    c = _CLASS[data]
    if len(c) > 1:
        out[:256] = np.sqrt(np.bincount(c[:-1] * np.uint8(16) + c[1:], minlength=256) / (len(c) - 1))
    space = (c == 4) | (c == 5)
    words = int(np.count_nonzero(~space[1:] & space[:-1])) + int(not space[0])
    lines = bytes(data).split(b"\n")
    out[256:] = (
        np.count_nonzero(~space) / max(words, 1) / 10,
        1 - len(set(lines)) / len(lines),
        np.log1p(len(lines)) / 5,
        np.count_nonzero(c == 1) / len(c) * 4,
        np.count_nonzero(c > 5) / len(c) * 4,
        np.count_nonzero(c == 2) / len(c) * 4,
    )
    return out


def metadata(sources: list, langs: list, lengths: np.ndarray) -> np.ndarray:
    """The metadata view: hashed source and language, and the length's half powers of two; null is a value of its own."""
    n = len(sources)
    out = np.zeros((n, _META), np.float32)
    row = np.arange(n)
    out[row, [0 if s is None else 1 + zlib.crc32(str(s).encode()) % (_SOURCES - 1) for s in sources]] = 1
    out[row, [_SOURCES + (0 if s is None else 1 + zlib.crc32(str(s).encode()) % (_LANGS - 1)) for s in langs]] = 1
    out[row, _SOURCES + _LANGS + np.minimum(np.log2(np.maximum(lengths, 0) + 1), _LENGTHS - 1).astype(int)] = 1
    return out


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps, the two classes weighing the same; the last weight is the constant."""
    x = np.hstack((x.astype(float), np.ones((len(x), 1))))
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / max(np.count_nonzero(y == 1), 1), 0.5 / max(np.count_nonzero(y == 0), 1)) * len(y)
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x.astype(float) @ w[:-1] + w[-1]


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_line: np.ndarray  # slope and constant that calibrate a view
    meta_line: np.ndarray
    both: np.ndarray
    labelled: int

    def probabilities(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probability of good quality by the text, by the metadata, and by both."""
        a = logit(text, self.text) * self.text_line[0] + self.text_line[1]
        b = logit(meta, self.meta) * self.meta_line[0] + self.meta_line[1]
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p(a), p(b), p(self.both[0] * a + self.both[1] * b + self.both[2])


#: What a pool tells of each view and class of the sure documents: how many, the gradient and the matrix of a Newton step.
Sums = dict[str, list[tuple[float, np.ndarray, np.ndarray]]]
#: (weights to step from, weights to label by) to sums.
Pool = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], Sums]


def pool_sums(views: dict[str, np.ndarray], weights: dict[str, np.ndarray], labels: dict[str, np.ndarray]) -> Sums:
    """Sums over documents, each labelled for one view by the other."""
    out: Sums = {}
    for own, other in (("text", "meta"), ("meta", "text")):
        z, x = logit(views[other], labels[other]), np.hstack((views[own].astype(float), np.ones((len(views[own]), 1))))
        out[own] = []
        for good in (0, 1):
            some = x[z > SURE if good else z < -SURE]
            p = 1 / (1 + np.exp(-np.clip(some @ weights[own], -30, 30)))
            out[own].append((float(len(some)), some.T @ (p - good), (some * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ some))
    return out


def _step(x: np.ndarray, y: np.ndarray, w: np.ndarray, pool: list[tuple[float, np.ndarray, np.ndarray]], ridge: float = 1.0) -> np.ndarray:
    """One Newton step over the labelled rows and the pool's sums. In both parts the two classes weigh the same."""
    x = np.hstack((x.astype(float), np.ones((len(x), 1))))
    weight = np.where(y == 1, 0.5 / max(np.count_nonzero(y == 1), 1), 0.5 / max(np.count_nonzero(y == 0), 1)) * len(y)
    penalty = np.append(np.full(len(w) - 1, ridge), 1e-3)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    gradient = x.T @ (weight * (p - y)) + penalty * w
    curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
    for n, g, h in pool:
        if n:
            scale = POOL_WEIGHT * 0.5 * len(y) / n
            gradient, curve = gradient + scale * g, curve + scale * h
    return w - np.linalg.solve(curve, gradient)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool, rounds: int = ROUNDS) -> Model:
    """Fits both views; every fifth labelled row is kept aside for calibration. With one class only, or too few
    rows to keep any aside, the model says the labels' share for every document."""
    aside = np.arange(len(y)) % 5 == 4
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        share = np.clip((y.sum() + 1) / (len(y) + 2), 1e-3, 1 - 1e-3) if len(y) else 0.5
        z, line = np.log(share / (1 - share)), np.array([0.0, 0.0])
        return Model(np.zeros(_CONTENT + 1), np.zeros(_META + 1), line, line, np.array([0.0, 0.0, z]), len(y))
    views, known = {"text": text[~aside], "meta": meta[~aside]}, y[~aside]
    weights = {k: regression(x, known) for k, x in views.items()}
    for _ in range(rounds):
        labels = weights
        for _ in range(STEPS):
            sums = pool(weights, labels)
            weights = {k: _step(x, known, weights[k], sums[k]) for k, x in views.items()}
    za, zb, ya = logit(text[aside], weights["text"]), logit(meta[aside], weights["meta"]), y[aside]
    line = lambda z: _plain(z[:, None], ya)
    la, lb = line(za), line(zb)
    both = _plain(np.column_stack((za * la[0] + la[1], zb * lb[0] + lb[1])), ya)
    return Model(weights["text"], weights["meta"], la, lb, both, len(y))


def _plain(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression at the rows' own class shares, for calibration; slopes are not negative."""
    x1 = np.hstack((x, np.ones((len(x), 1))))
    w = np.zeros(x1.shape[1])
    ridge = np.append(np.full(x.shape[1], 0.5), 1e-3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        w -= np.linalg.solve((x1 * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x1 + np.diag(ridge), x1.T @ (p - y) + ridge * w)
    w[:-1] = np.maximum(w[:-1], 0)
    return w


def _views(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = flat(part.column("text"))
    text = np.array([content(data[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.float32).reshape(-1, _CONTENT)
    length = part.column("n_chars").fill_null(0).to_numpy(zero_copy_only=False)
    return text, metadata(part.column("source").to_pylist(), part.column("lang").to_pylist(), length)


def stored_views(docs: DataFrame) -> DataFrame:
    """(doc_id, x) of all documents with an id and a text, written once: both views as 32-bit numbers, the content
    first; of the metadata only the places that are 1."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, "text", 1 << 20):
                text, meta = _views(part)
                x = np.hstack((text, np.flatnonzero(meta.ravel()).reshape(len(meta), _ONES) % _META)).astype("<f4")
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    usable = _columns(docs).where((F.octet_length("text") > 0) & F.col("doc_id").isNotNull())
    return stored(usable.mapInArrow(run, "doc_id long, x binary"), "views")


def _unpacked(column: pa.Array) -> dict[str, np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, _CONTENT + _ONES)
    meta = np.zeros((len(x), _META), np.float32)
    np.put_along_axis(meta, x[:, _CONTENT:].astype(np.int64), 1, axis=1)
    return {"text": x[:, :_CONTENT], "meta": meta}


_SHAPE = [(k, good, n) for k, n in (("text", _CONTENT + 1), ("meta", _META + 1)) for good in (0, 1)]


def _flat_sums(sums: Sums) -> np.ndarray:
    return np.concatenate([np.concatenate(([sums[k][good][0]], sums[k][good][1], sums[k][good][2].ravel())) for k, good, _ in _SHAPE])


def _of_flat(flat: np.ndarray) -> Sums:
    out: Sums = {"text": [], "meta": []}
    for k, _, n in _SHAPE:
        out[k].append((flat[0], flat[1 : n + 1], flat[n + 1 : n + 1 + n * n].reshape(n, n)))
        flat = flat[1 + n + n * n :]
    return out


def distributed_pool(views: DataFrame, ways: int = 32) -> Pool:
    """The sums over all rows of views. A partition makes one matrix of fixed size, and ways tasks add them up."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            for data in batch.column("sums").to_pylist():
                total = total + np.frombuffer(data)
        if not isinstance(total, float):
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    def pool(weights: dict[str, np.ndarray], labels: dict[str, np.ndarray]) -> Sums:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0.0
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    total = total + _flat_sums(pool_sums(_unpacked(batch.slice(a, 1024).column("x")), weights, labels))
            if not isinstance(total, float):
                yield pa.RecordBatch.from_pydict({"way": pa.array([TaskContext.get().partitionId() % ways], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        each = views.select("x").mapInArrow(run, "way int, sums binary").repartition(ways, "way")
        rows = each.select("sums").mapInArrow(added, "sums binary").collect()
        empty = np.zeros(sum(1 + n + n * n for _, _, n in _SHAPE))
        return _of_flat(sum((np.frombuffer(r.sums) for r in rows), empty))

    return pool


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> Model:
    """Learns from at most labelled documents with a label, the first by hash of id, and from all others as the pool.

    Of several labels of a document the mean counts, a half being good; null labels don't. A document that has
    several rows is learnt from once where it is labelled. Rows without id or text aren't learnt from.
    """
    spark = docs.sparkSession
    views = stored_views(docs)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    first = known.join(views.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    chosen = F.broadcast(spark.createDataFrame([(r.doc_id, float(r.y)) for r in first], "doc_id long, y double"))
    rows = views.join(chosen, "doc_id").groupBy("doc_id", "y").agg(F.min("x").alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    own = _unpacked(pa.array([r.x for r in rows], pa.binary()))
    return co_train(own["text"], own["meta"], np.array([r.y for r in rows], float), distributed_pool(views.join(chosen, "doc_id", "left_anti")), rounds)


def _columns(docs: DataFrame) -> DataFrame:
    have = set(docs.columns)
    take = lambda c, kind: (F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)).alias(c)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", take("source", "string"), take("lang", "string"), take("n_chars", "long"))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, reject_below: float = REJECT_BELOW) -> DataFrame:
    """Adds text_score, meta_score, quality_score (0 to 1) and kept to docs' columns, or to those in keep.

    A document is kept if quality_score is reject_below or more. A null or empty text has scores 0 and is
    not kept. Missing or null metadata count as a value of their own. Columns of those four names are
    replaced; repeated rows give a row each; an empty table gives an empty result; texts of any length are read whole.
    """
    small_batches(docs.sparkSession)
    made = ("text_score", "meta_score", "quality_score", "kept")
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in made]
    schema = docs.select(*kept).schema
    for c in made[:3]:
        schema = schema.add(c, "double")
    schema = schema.add("kept", "boolean")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    needed = _columns(docs).columns
    # the text goes to the workers once
    text_name = "text" if "text" in kept else "_text"
    names = [text_name if c == "text" else f"_{c}" for c in needed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in pieces(whole, text_name, 1 << 20):
                own = pa.RecordBatch.from_arrays([part.column(n) for n in names], names=needed)
                p = sent.value.probabilities(*_views(own))
                empty = np.array([not x for x in own.column("text").to_pylist()], bool)
                p = [np.where(empty, 0.0, x) for x in p]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), *(pa.array(x, pa.float64()) for x in p), pa.array((p[2] >= reject_below) & ~empty, pa.bool_())], names=[*kept, *made]
                )

    have = set(docs.columns)
    take = lambda c, kind: (F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)).alias(f"_{c}")
    view = [take("doc_id", "long"), *([F.col("text").alias("_text")] if text_name == "_text" else []), take("source", "string"), take("lang", "string"), take("n_chars", "long")]
    return docs.select(*kept, *view).mapInArrow(run, schema)
