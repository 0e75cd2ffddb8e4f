"""Document fingerprints by locally consistent parsing.

A text's bytes are names of level 0. At each level, runs of one name become one, neighbours then differ, and deterministic
coin tossing gives each name a colour of three that depends on a few names to its left and right only: a name's label is the
place and value of the lowest bit in which it differs from the one before, over again until six labels are left, and then
three. Local maxima of colours, and minima that have no maximum beside them, begin phrases of two or three names; a phrase's
name is a hash of its names. So equal substrings have equal phrases but for a few at their ends, wherever they lie.

A fingerprint is a sketch of the set of a text's phrases of level LEVEL and above (of the topmost one, where a text is too
short for that level): the least hash of each of BINS parts of the hash range, cut to a byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import flat, mixed, pieces, release, small_batches, stored

#: The lowest level whose phrases count (some 15 to 20 bytes long), and bins of a fingerprint.
LEVEL, BINS = 3, 128
#: Bytes of text that are parsed at once; names that are coloured at once, and those around them that they depend on.
PIECE, WINDOW, MARGIN = 1 << 20, 1 << 16, 16

_ODD = mixed(np.arange(1, 17, dtype=np.uint64)) | np.uint64(1)
_BYTE = mixed(np.arange(1000, 1256, dtype=np.uint64))


def _tossed() -> np.ndarray:
    """The label for each pair (label before, label): twice the lowest bit that differs, plus that bit's value."""
    low = np.arange(256)
    differs = low[:, None] ^ low[None, :]
    bit = np.bitwise_count((differs & -differs) - 1).astype(int) % 8
    return (2 * bit + ((low[None, :] >> bit) & 1)).astype(np.uint8).ravel()


def _free() -> np.ndarray:
    """The least colour of three that neither neighbour has, by (left, right); 6 and 7 are no neighbour."""
    return np.array([min({0, 1, 2} - {a, b}) for a in range(8) for b in range(8)], np.uint8)


_TOSSED, _FREE = _tossed(), _free()


def _toss(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    pair = label.astype(np.uint16)
    pair[1:] |= label[:-1].astype(np.uint16) << np.uint16(8)
    out = _TOSSED[pair]
    out[first] = label[first] & 1
    return out


def colours(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A colour of 0, 1, 2 for each name, another one than its neighbours'. first: places where a text begins; within a text
    neighbours differ."""
    if names.dtype == np.uint8:
        label = _toss(names, first)
    else:
        differs = names.copy()
        differs[1:] ^= names[:-1]
        differs[first] = 1
        bit = np.bitwise_count((differs & (~differs + np.uint64(1))) - np.uint64(1))
        label = (bit << 1) | ((names >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        label = _toss(label, first)
    label = _toss(_toss(label, first), first)
    side = np.full(len(label) + 2, 7, np.uint8)
    begins = np.zeros(len(label) + 1, bool)
    begins[first] = True
    begins[-1] = True
    for c in (3, 4, 5):
        side[1:-1] = label
        at = np.flatnonzero(label == c)
        left, right = side[at], side[at + 2]
        left[begins[at]] = 7
        right[begins[at + 1]] = 7
        label[at] = _FREE[left.astype(np.intp) * 8 + right]
    return label


def _landmarks(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each name begins a phrase, by colours alone."""
    c = colours(names, first)
    less, more = np.zeros(len(c), bool), np.zeros(len(c), bool)
    up = c[1:] > c[:-1]
    more[1:-1] = up[:-1] & ~up[1:]
    less[1:-1] = ~up[:-1] & up[1:]
    # another text's names aren't neighbours
    more[first] = False
    more[first[first > 0] - 1] = False
    less[1:] &= ~more[:-1]
    less[:-1] &= ~more[1:]
    return more | less


def parse(names: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level: the phrases' names, the n + 1 offsets of each text's phrases, and where each phrase begins in names.

    A text of one name or more has one phrase at least; of two or more, at most half as many phrases as names.
    """
    if not len(names):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64), np.zeros(0, np.int64)
    head = np.ones(len(names), bool)
    np.not_equal(names[1:], names[:-1], out=head[1:])
    full = np.flatnonzero(np.diff(starts))
    head[starts[full]] = True
    at = np.flatnonzero(head)
    run = np.diff(np.append(at, len(names)))
    kept = names[at]
    first = np.searchsorted(at, starts[full])  # of texts that aren't empty
    marks = np.zeros(len(kept), bool)
    for a in range(0, len(kept), WINDOW):
        b = min(a + WINDOW, len(kept))
        low, high = max(0, a - MARGIN), min(len(kept), b + MARGIN)
        inside = first[np.searchsorted(first, low) : np.searchsorted(first, high)] - low
        if not len(inside) or inside[0]:
            inside = np.concatenate(([0], inside))
        marks[a:b] = _landmarks(kept[low:high], inside)[a - low : b - low]
    last = np.append(first[1:], len(kept)) - 1
    # a phrase has two names at least: none begins at a text's second or last name
    marks[first + (last > first)] = False
    marks[last] = False
    marks[first] = True
    begin = np.flatnonzero(marks)
    size = np.diff(np.append(begin, len(kept)))
    total = np.zeros(len(begin), np.uint64)
    for k in range(int(size.max())):
        has = np.flatnonzero(size > k) if k else slice(None)
        i = begin[has] + k
        value = _BYTE[kept[i]] if kept.dtype == np.uint8 else kept[i]
        total[has] += value * (2 * run[i] - 1).astype(np.uint64) * _ODD[k % len(_ODD)]
    return mixed(total), np.searchsorted(at[begin], starts), at[begin]


def phrases_of(data: np.ndarray, offsets: np.ndarray, level: int = LEVEL) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, text, phrase name, first byte) of the phrases of a level and all above, up to a text's topmost one; of a text
    that doesn't reach the level, the topmost phrase. Bytes are counted from the first text's start."""
    names, starts = data, offsets
    text, place = np.arange(len(offsets) - 1), None
    for now in range(1, 64):
        names, starts, at = parse(names, starts)
        place = at if place is None else place[at]
        count = np.diff(starts)
        whole = count == 1
        out = np.repeat(np.ones(len(text), bool) if now >= level else whole, count)
        if out.any():
            yield now, np.repeat(text, count)[out], mixed(names[out] + np.uint64(now)), place[out]
        left = count > 1
        if not left.any():
            return
        stay = np.repeat(left, count)
        names, place, text = names[stay], place[stay], text[left]
        starts = np.concatenate(([0], np.cumsum(count[left])))


def sketches(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of BINS bytes for each text: 0 where no phrase falls into the bin, else 1 to 255 from the least hash in it."""
    n = len(offsets) - 1
    least = np.full(n * BINS, ~np.uint64(0))
    width = np.uint64(64 - int(BINS - 1).bit_length())
    for _, text, name, _ in phrases_of(data, offsets):
        np.minimum.at(least, text * BINS + (name >> width).astype(np.int64), name)
    out = np.where(least == ~np.uint64(0), 0, 1 + mixed(least) % np.uint64(255)).astype(np.uint8)
    return out.reshape(n, BINS)


def likenesses(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much of two texts' phrases is common, 0 to 1 (an estimate of the Jaccard index), for rows of sketches: the share of
    equal bins among those that either has, less what 255 values share by chance. Equal sketches have 1."""
    either = ((a | b) != 0).sum(axis=1)
    same = ((a == b) & (a != 0)).sum(axis=1)
    share = same / np.maximum(either, 1)
    return np.where((a == b).all(axis=1), 1.0, np.clip((share - 1 / 255) / (1 - 1 / 255), 0, 1))


def likeness(a: Column, b: Column) -> Column:
    """likenesses() of two columns of fingerprints (hexadecimal strings), without Python."""
    bins = lambda c, i: F.substring(c, 2 * i + 1, 2)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.struct(bins(a, i).alias("a"), bins(b, i).alias("b")))
    either = F.size(F.filter(pairs, lambda p: (p["a"] != "00") | (p["b"] != "00")))
    same = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != "00")))
    share = (same / F.greatest(either, F.lit(1)) - 1 / 255) / (1 - 1 / 255)
    return F.when(a == b, 1.0).otherwise(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))


def fingerprints(docs: DataFrame, text_column: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints, 2 * BINS hexadecimal digits; a column of that name is replaced.

    A null text counts as an empty one, whose fingerprint is zeros. Equal texts have equal fingerprints. Other columns, ties and
    repeated rows stay as they are; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != name]
    work = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                made = sketches(*flat(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array([r.tobytes() for r in made], pa.binary())], names=["row", "f"])
            release()

    kind = work.schema["row"].dataType.simpleString()
    found = work.mapInArrow(run, f"row {kind}, f binary")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in rest], F.lower(F.hex("f")).alias(name))


def phrases(docs: DataFrame, level: int = LEVEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each phrase of a level and above: doc_id, level, start (byte), name (64 bits). Texts that share a passage share
    the names of its inner phrases, so that a join on (level, name) finds shared passages. Null and empty texts have none."""
    small_batches(docs.sparkSession)
    work = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                data, offsets = flat(part.column("text"))
                for now, text, name, at in phrases_of(data, offsets, level):
                    columns = [part.column("doc_id").take(pa.array(text)), pa.array(np.full(len(text), now, np.int32)), pa.array(at - offsets[text]), pa.array(name.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "level", "start", "name"])

    return work.mapInArrow(run, "doc_id long, level int, start long, name long")


_PAIR = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> list[pa.Array]:
    """The columns of _PAIR for texts with the one that follows each; own and after are their sketches."""
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, following, strict=True)]
    raw = pa.array(edited, pa.large_string())
    made = [np.zeros((0, BINS), np.uint8)]
    for part in pieces(pa.RecordBatch.from_arrays([raw], names=["text"]), "text", PIECE):
        made.append(sketches(*flat(part.column("text"))))
    changed = np.concatenate(made)
    packed = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
    return [
        pa.array(ids, pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).digest() for e in edited], pa.binary()),
        packed(own),
        packed(changed),
        pa.array(likenesses(own, changed)),
        pa.array(likenesses(own, after)),
    ]


def edit_probe(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of texts and of the same texts with their second half overwritten by the next document's beginning.

    Per row: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited (likeness to the edited
    text), near_next (to the next document). The next document is the following one by descending doc_id, then by the text's hash,
    null ids last; the first one follows the last. The last floor(n_chars / 2) code points are replaced by as many of the next
    text's first, or all of it. Null texts count as empty. A single document follows itself; an empty table gives an empty result;
    other columns are ignored.

    Rows are dealt by ranges of ids (repeated rows to several tasks), so that next to each row is its follower; only the rows at
    the ranges' ends are joined.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    dealt = work.repartitionByRange(*order, F.monotonically_increasing_id()).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()

        def edge(kind: int, row: tuple) -> pa.RecordBatch:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *none, pa.array([task], pa.int32()), pa.array([kind], pa.int32()), pa.array([row[1]], pa.string())], names=names)

        held = None
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                ids, texts, made = part.column("doc_id").to_pylist(), part.column("text").to_pylist(), sketches(*flat(part.column("text")))
                if held is None:
                    yield edge(1, (ids[0], texts[0]))
                else:
                    ids, texts, made = [held[0], *ids], [held[1], *texts], np.concatenate((held[2], made))
                held = ids[-1], texts[-1], made[-1:]
                if len(ids) > 1:
                    n = len(ids) - 1
                    columns = _compared(ids[:-1], texts[:-1], texts[1:], made[:-1], made[1:])
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], names=names)
            release()
        if held is not None:
            yield edge(2, held)

    names = [c.split(" ")[0] for c in _PAIR.split(", ")] + ["task", "edge", "text"]
    made = stored(dealt.mapInArrow(run, f"{_PAIR}, task int, edge int, text string"), "probed")
    # two rows a task at most
    tasks = sorted(r.task for r in made.where("edge = 1").select("task").collect())
    following = spark.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, next int")
    lasts = made.where("edge = 2").select("task", "doc_id", "text").join(F.broadcast(following), "task")
    firsts = made.where("edge = 1").select(F.col("task").alias("next"), F.col("text").alias("following"))

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                own, after = sketches(*flat(part.column("text"))), sketches(*flat(part.column("following")))
                columns = _compared(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), part.column("following").to_pylist(), own, after)
                yield pa.RecordBatch.from_arrays(columns, names=names[:-3])

    ends = lasts.join(firsts, "next").select("doc_id", "text", "following").mapInArrow(at_edges, _PAIR)
    both = made.where("edge is null").select(*names[:-3]).unionByName(ends)
    return both.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
