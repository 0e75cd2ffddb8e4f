"""Language identification by string kernels.

The kernel of two texts is the blended spectrum of byte n-grams (1 to 3) by presence: the number of
n-grams that both have, over the root of the product of their numbers of distinct n-grams. Some of the
training texts are landmarks; texts become Nyström features of their kernel values with the landmarks,
and one kernel ridge regression for each language scores them. Texts are scored whole, in batches, by
matrix products. What is gathered of a training text is its set of n-grams, which the alphabet bounds
however long the text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import flat, pieces, small_batches, stored

UNKNOWN = "und"
#: Bounds of what is fitted: distinct training texts for each language, and landmarks among them.
TRAIN_EACH, LANDMARKS_EACH = 300, 24
RIDGE, SHARPNESS = 1e-2, 6.0
#: Languages that a model may have.
MOST_LANGUAGES = 400

# letters a-z are 1 to 26, bytes from 128 are 27 to 154, all others are one gap
_CODE = np.zeros(256, np.int32)
_CODE[97:123] = _CODE[65:91] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_SIZE = 160
#: Codes of n-grams: those of one byte come first, then those of two, then those of three.
_TWO, _THREE, _CODES = _SIZE, _SIZE + _SIZE**2, _SIZE + _SIZE**2 + _SIZE**3
_last: list[np.ndarray] = []


def grams(data: np.ndarray) -> np.ndarray:
    """Codes of all 1-, 2- and 3-grams of one text's bytes, with repeats. Equal codes, equal n-grams."""
    c = _CODE[data]
    two = c[:-1] * _SIZE + c[1:]
    return np.concatenate((c, two + _TWO, two[:-1] * _SIZE + c[2:] + _THREE)) if len(c) > 2 else np.concatenate((c, two + _TWO))


def distinct(codes: np.ndarray) -> np.ndarray:
    """Marks one of each code: the last, which is what is left where all have written their place."""
    if not _last:
        _last.append(np.zeros(_CODES, np.int32))
    at = np.arange(len(codes), dtype=np.int32)
    _last[0][codes] = at
    return _last[0][codes] == at


def gram_set(data: np.ndarray) -> np.ndarray:
    """The distinct n-grams of one text, in order."""
    codes = grams(data)
    return np.sort(codes[distinct(codes)])


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # the n-grams of the landmarks, in order; others can't match any
    landmarks: np.ndarray  # n-grams x landmarks, scaled by the landmarks' roots
    project: np.ndarray  # landmarks x features
    weights: np.ndarray  # features + 1 x languages

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "place"}

    @cached_property
    def place(self) -> np.ndarray:
        """Each n-gram's place among the codes; the place after the last is for others."""
        table = np.full(_CODES, len(self.codes), np.int32)
        table[self.codes] = np.arange(len(self.codes))
        return table

    def kernel(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given as their n-grams, with the landmarks."""
        rows = np.zeros((len(texts), len(self.codes) + 1), np.float32)
        own = np.empty(len(texts))
        for i, codes in enumerate(texts):
            rows[i][self.place[codes]] = 1
            own[i] = np.count_nonzero(distinct(codes))
        return (rows[:, :-1] @ self.landmarks) / np.sqrt(np.maximum(own, 1)).astype(np.float32)[:, None]

    def features(self, texts: list[np.ndarray]) -> np.ndarray:
        return np.hstack((self.kernel(texts) @ self.project, np.ones((len(texts), 1), np.float32)))

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        return self.features(texts) @ self.weights

    def predict(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the best languages and their scores from 0 to 1 (a softmax of the regressions)."""
        s = SHARPNESS * self.scores(texts).astype(float)
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return s.argmax(axis=1), (e / e.sum(axis=1, keepdims=True)).max(axis=1)


def fit(sets: list[np.ndarray], languages: list[str], landmarks_each: int = LANDMARKS_EACH) -> Model:
    """sets are the texts' gram_set()s. Landmarks are the first texts of each language, in the order given."""
    known = sorted(set(languages))
    if not known:
        return Model([], np.zeros(0, np.int32), np.zeros((0, 0)), np.zeros((0, 0)), np.zeros((0, 0)))
    left = dict.fromkeys(known, landmarks_each)
    chosen = []
    for i, lang in enumerate(languages):
        if left[lang]:
            left[lang] -= 1
            chosen.append(i)
    codes = np.unique(np.concatenate([sets[i] for i in chosen] + [np.zeros(1, np.int32)]))
    model = Model(known, codes, np.zeros((len(codes), len(chosen)), np.float32), np.zeros((1, 0), np.float32), np.zeros((1, 1), np.float32))
    for k, i in enumerate(chosen):
        model.landmarks[np.searchsorted(codes, sets[i]), k] = 1 / np.sqrt(max(len(sets[i]), 1))
    own = (model.landmarks.T @ model.landmarks).astype(float)
    value, vector = np.linalg.eigh(own)
    keep = value > 1e-6 * value.max()
    model.project = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)
    x = np.vstack([model.features(sets[a : a + 128]) for a in range(0, len(sets), 128)]).astype(float)
    y = np.where(np.array(languages)[:, None] == np.array(known)[None, :], 1.0, -1.0)
    # every language weighs the same
    share = 1 / np.array([languages.count(lang) for lang in known], float)
    w = share[np.searchsorted(known, languages)] * len(languages) / len(known)
    model.weights = np.linalg.solve((x * w[:, None]).T @ x + RIDGE * len(x) * np.eye(x.shape[1]) / 100, (x * w[:, None]).T @ y).astype(np.float32)
    return model


def training_sample(docs: DataFrame, modulus: int, remainder: int, each: int = TRAIN_EACH) -> tuple[list[np.ndarray], list[str]]:
    """A bounded sample of each language's texts, as gram_set()s: the first by hash of text, of the distinct ones of
    rows with a language, a text that isn't empty, and crc32(doc_id) mod modulus other than remainder.

    Texts of any length are taken. Copies count once, so at most each rows of a language come to the driver.
    """
    small_batches(docs.sparkSession)
    ids = F.col("doc_id").cast("string")
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(ids.cast("binary")) % modulus != remainder) & (F.octet_length("text") > 0))
    able = able.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("t"))
    texts = stored(able.groupBy("lang", "t").agg(F.min("doc_id").alias("doc_id")), "texts")
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not sizes:
        return [], []
    # hashes are even: four times as many as are wanted lie below the bound of a language, a few rows of any table
    below = docs.sparkSession.createDataFrame([(r.lang, 4 * each / r.n) for r in sizes], "lang string, below double")
    h = F.shiftrightunsigned(F.xxhash64("t"), 11) / float(1 << 53)
    first = texts.withColumn("h", h).join(F.broadcast(below), "lang").where(F.col("h") < F.col("below")).select("doc_id", "lang", "t", "h").collect()
    left, place = dict.fromkeys([r.lang for r in sizes], each), {}
    for r in sorted(first, key=lambda r: (r.h, r.lang)):
        if left[r.lang]:
            left[r.lang] -= 1
            place[r.lang, r.t] = r.h, r.doc_id
    picked = docs.sparkSession.createDataFrame([(i, lang, t) for (lang, t), (_, i) in place.items()], "doc_id long, lang string, t long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                data, offsets = flat(batch.column("text"))
                sets = [gram_set(data[a:b]).astype("<i4").tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("t"), pa.array(sets, pa.binary())], names=["lang", "t", "grams"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").withColumn("t", F.xxhash64("text")).join(F.broadcast(picked), ["doc_id", "lang", "t"])
    got = rows.select("lang", "t", "text").mapInArrow(run, "lang string, t long, grams binary").groupBy("lang", "t").agg(F.min("grams").alias("grams")).collect()
    got.sort(key=lambda r: (place[r.lang, r.t], r.lang))
    return [np.frombuffer(r.grams, "<i4") for r in got], [r.lang for r in got]


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None, text_column: str = "text") -> DataFrame:
    """Adds lang_pred and score to docs' columns (or those in keep).

    A null text, or one without a letter, is "und" with score 0, as is every text if no language was
    learnt. Only the text is looked at. Columns named lang_pred or score are replaced, others are kept; repeated
    rows give a row each, equal texts the same values, and an empty table an empty result. Texts of any length are scored whole.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in (keep if keep is not None else docs.columns) if c not in ("lang_pred", "score")]
    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double")
    own = text_column if text_column in kept else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for batch in pieces(whole, text_column, 1 << 20):
                for a in range(0, batch.num_rows, 256):
                    part = batch.slice(a, 256)
                    column = part.column(text_column)
                    data, offsets = flat(column)
                    texts = [data[x:y] for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                    able = np.array([bool(_ASCII_LETTER[t].any()) or (len(t) > 0 and has_letter(column[i].as_py())) for i, t in enumerate(texts)], bool)
                    lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                    if m.languages and able.any():
                        best, value = m.predict([grams(t) for t, ok in zip(texts, able, strict=True) if ok])
                        lang[able], score[able] = np.array(m.languages, object)[best], value
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"]
                    )

    return docs.select(*kept, *([] if own else [text_column])).mapInArrow(run, schema)


def identify(docs: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; held_out rows were not learnt from. A null doc_id is
    not held out, nor learnt from; repeated rows have a row each. For other cases see predict()."""
    model = fit(*training_sample(docs, modulus, remainder))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
