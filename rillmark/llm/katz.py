"""Language-model scoring by Katz backoff.

Counts come from all training documents. Seen n-grams are discounted by Good-Turing, unseen ones get
the lower order's probability times the history's backoff weight, which is normalised exactly; the lower order
backs off in the same way, down to words.

Layout. Documents become blocks of packed tokens, written once. Order by order, each block counts its own
distinct n-grams and asks for them at tables that are partitioned by the hash of the history, so the exchange
carries an n-gram once a block however often it occurs. A table's part adds the counts up, and answers each
block with the counts of what it asked for and with what a backoff weight needs of each history: how many next
words have which count, and which count of the lower order. All of that are whole numbers: sums are exact, and an
n-gram that has been seen has a shorter form that has been seen, so the weights need nothing else. Then each
block scores its documents. Nothing is broadcast but the counts of counts.

A block that holds all texts in which a history occurs doesn't ask for it: its own counts are the whole. So with an
n-gram whose shorter form occurs nowhere else; of these the table is told the history's sums alone. For that, all
occurrences are counted beside those in training.

Bounds. There are as many parts as the tokens need, BUCKET_TOKENS each, and a history that has been seen very
often is spread over parts by its next word, one for HOT of its tokens; a block asks all of them for their sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import distinct, flat, free_shuffles, mixed, ordered, pieces, release, small_batches, stored, stored_by, words

ORDER = 3
#: Text bytes of a block, tokens that a part of a table stands for, and tokens of a history from which it is spread.
BLOCK_BYTES, BUCKET_TOKENS, HOT = 3 << 20, 2 << 20, 1 << 18
#: Counts above this are not discounted.
UNDISCOUNTED = 5
#: The hash of the end of a text, which no word has but by chance.
END = np.uint64(0xE2D0_0000_0000_0003)
#: The start of a text, as a number beside those of words: salts lie above it.
_START, _LOW48 = np.uint64(2**40 - 1), np.uint64(2**48 - 1)
#: Two words whose numbers are less than this are known as history by these; the start of a text then counts as this number.
_NUMBERED = np.uint64(2**24 - 1)
_HASHED = np.uint64(2**63)
_ODD, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
#: What is told of a history: next words of count 1 .. UNDISCOUNTED and tokens of greater counts; then the same by the
#: count of the lower order, of those next words that have been seen.
_SUMS = 2 * (UNDISCOUNTED + 1)

_BLOCK = "block long, n_tokens long, ids binary, part binary, sizes binary, vocabulary binary, tokens binary"
_ZSTD: dict[str, object] = {}


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as zstd of their bytes, the lowest bytes of all first; bytes that all have 0 are left out. While most are 0 or 1,
    a bit each tells which aren't 0, and these go on less 1."""
    import zstandard

    values = np.ascontiguousarray(values.ravel(), "<u8")
    n, masks = len(values), []
    while len(masks) < 15 and values.any() and 5 * np.count_nonzero(values < 2) > 3 * len(values):
        some = values > 0
        masks.append(np.packbits(some))
        values = values[some] - np.uint64(1)
    width = (int(values.max(initial=0)).bit_length() + 7) // 8
    every, planes = values.view(np.uint8).reshape(-1, 8), np.empty((width, len(values)), np.uint8)
    for k in range(width):
        planes[k] = every[:, k]
    head = bytes([len(masks) << 4 | width]) + (n.to_bytes(8, "little") if masks else b"")
    return head + _ZSTD.setdefault("c", zstandard.ZstdCompressor(level=3)).compress(np.concatenate((*masks, planes.ravel())))


def unpacked(data: bytes) -> np.ndarray:
    """The numbers as unsigned 64-bit."""
    import zstandard

    levels, width = data[0] >> 4, data[0] & 15
    planes = np.frombuffer(_ZSTD.setdefault("d", zstandard.ZstdDecompressor()).decompress(data[9 if levels else 1 :]), np.uint8)
    masks, n = [], int.from_bytes(data[1:9], "little") if levels else 0
    for _ in range(levels):
        masks.append(np.unpackbits(planes[: -(-n // 8)], count=n).view(bool))
        planes, n = planes[-(-n // 8) :], int(np.count_nonzero(masks[-1]))
    if width > 1:
        out = np.zeros((planes.size // width, 8), np.uint8)
        for k, plane in enumerate(planes.reshape(width, -1)):
            out[:, k] = plane
        values = out.view("<u8").ravel()
    else:
        values = planes.astype(np.uint64) if width else np.zeros(n, np.uint64)
    for some in reversed(masks):
        wider = np.zeros(len(some), np.uint64)
        wider[some] = values + np.uint64(1)
        values = wider
    return values


def _filled(data: bytes, n: int) -> np.ndarray:
    """unpacked() of n numbers, which may all be 0."""
    got = unpacked(data).view(np.int64)
    return got if len(got) else np.zeros(n, np.int64)


#: What a document is for: learnt from, held out, or scored alone, as its id is null.
LEARN, HELD_OUT, NO_ID = range(3)


def part_of(ids: pa.Array, modulus: int, remainder: int) -> np.ndarray:
    """LEARN, HELD_OUT or NO_ID for each id."""
    return np.fromiter((NO_ID if i is None else HELD_OUT if zlib.crc32(str(i).encode()) % modulus == remainder else LEARN for i in ids.to_pylist()), np.uint8, len(ids))


def token_blocks(docs: DataFrame, modulus: int, remainder: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents as blocks of packed tokens, stored in buckets by block, so that what is joined to them moves and they
    don't; each text ends with END. Null texts are empty."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, number
            ids = np.concatenate([h[0] for h in held])
            count = np.concatenate([h[1] for h in held])
            vocabulary, tokens = np.unique(np.concatenate([h[2] for h in held]), return_inverse=True)
            # frequent words get small places, which take less room
            order = np.argsort(-np.bincount(tokens), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            vocabulary, tokens = vocabulary[order], place[tokens]
            row = (part << 32 | number, len(tokens), ids.astype("<i8").tobytes(), np.concatenate([h[3] for h in held]).tobytes(), count.astype("<i8").tobytes(), vocabulary.tobytes(), packed(tokens))
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)], names=["block", "n_tokens", "ids", "part", "sizes", "vocabulary", "tokens"]
            )

        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                data, offsets = flat(batch.column("text"))
                hashes, starts = words(data, offsets)
                ids = batch.column("id")
                held.append((ids.fill_null(0).to_numpy(zero_copy_only=False), np.diff(starts) + 1, np.insert(hashes, starts[1:], END), part_of(ids, modulus, remainder)))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield out()
                    release()
        if held:
            yield out()
        release()

    made = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, _BLOCK)
    return stored_by(made, "tokens", "block")


class _Block:
    """A block unpacked: tokens as places in the vocabulary, and who trains."""

    def __init__(self, row: dict) -> None:
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.part = np.frombuffer(row["part"], np.uint8)
        self.sizes = np.frombuffer(row["sizes"], "<i8")
        self.vocabulary = np.frombuffer(row["vocabulary"], "<u8")
        self.tokens = _filled(row["tokens"], row["n_tokens"])
        self.first = np.cumsum(self.sizes) - self.sizes
        self.trains = np.repeat(self.part == LEARN, self.sizes)


class _Order:
    """The distinct n-grams of a block of one order. Histories are the n-grams of the order below, and one more: the
    start of a text. at is each token's n-gram; hist, word and lower are each n-gram's history, last word and shorter form;
    own and every count it in training and at all."""

    def __init__(self, b: _Block, at: np.ndarray, below: int) -> None:
        histories = np.concatenate((np.zeros(1, np.int64), at[:-1]))
        histories[b.first] = below
        size = len(b.vocabulary)
        grams, _, self.at = distinct(histories * size + b.tokens)
        self.hist, self.word = np.divmod(grams, size)
        self.lower = np.empty(len(grams), np.int64)
        self.lower[self.at] = at
        self.every = np.bincount(self.at, minlength=len(grams))
        self.own = np.bincount(self.at[b.trains], minlength=len(grams))


def _sums(hist: np.ndarray, count: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
    """What is told of histories (see _SUMS), from their n-grams that have been seen."""
    seen = np.flatnonzero(count)
    out = np.zeros((_SUMS, size), np.int64)
    for half, c in enumerate((count[seen], low[seen])):
        np.add.at(out.reshape(-1), (half * (UNDISCOUNTED + 1) + np.minimum(c, UNDISCOUNTED + 1) - 1) * size + hist[seen], np.where(c > UNDISCOUNTED, c, 1))
    return out


class _Units:
    """What an order's n-grams are asked for by: a unit is a history in one part, of several if it is hot. Everything is in
    order of part and unit's key, so that answers find their places again. closed histories and local n-grams are known."""

    def __init__(self, o: _Order, keys: np.ndarray, counts: np.ndarray, everywhere: np.ndarray, numbers: np.ndarray, n: int, named: np.ndarray | None, words: bool) -> None:
        here = np.bincount(o.hist, weights=o.every, minlength=len(keys)).astype(np.int64)
        self.closed = here == everywhere
        self.local = self.closed[o.hist] | (o.every == everywhere[o.lower])
        spread = np.where((here > 0) & ~self.closed, 1 + counts // HOT, 0)
        self.base = np.cumsum(spread) - spread
        self.of = np.repeat(np.arange(len(keys)), spread)
        salt = np.arange(len(self.of)) - self.base[self.of]
        mark = mixed(keys[self.of] + (salt + 1).astype(np.uint64) * _SALT)
        part = (mixed(mark) % np.uint64(n)).astype(np.int64)
        # a word or two as history are known by their numbers, which take less room than a hash
        key = _HASHED | mark >> np.uint64(16)
        if named is not None:
            place = named[self.of]
            key = np.where(place == _HASHED, key, place + (salt.astype(np.uint64) << np.uint64(40 if words else 48)))
        self.order = np.lexsort((key, part)) if n > 1 << 15 else ordered(part.astype(np.uint64) << np.uint64(49) | (key & _HASHED) >> np.uint64(15) | key & _LOW48)
        self.key = key[self.order]
        self.cuts = np.searchsorted(part[self.order], np.arange(n + 1))
        rank = np.empty(len(self.order), np.int64)
        rank[self.order] = np.arange(len(self.order))
        asked = np.flatnonzero(~self.local)
        hist = o.hist[asked]
        unit = rank[self.base[hist] + (mixed(numbers[o.word[asked]]) % spread[hist].astype(np.uint64)).astype(np.int64)]
        # in order of unit, then of n-gram: values that are sorted, not places, as these sort much faster
        self.grams = asked[np.sort(unit << 32 | np.arange(len(unit))) & 0xFFFFFFFF]
        self.runs = np.bincount(unit, minlength=len(self.order))
        self.ends = np.concatenate(([0], np.cumsum(self.runs)))
        # a history's local n-grams are told with its first unit
        tell = np.flatnonzero(self.local & ~self.closed[o.hist])
        self.told = _sums(rank[self.base[o.hist[tell]]], o.own[tell], counts[o.lower[tell]], len(self.order))

    def part(self, k: int) -> tuple[slice, np.ndarray]:
        """The units and the n-grams of part k."""
        a, b = self.cuts[k], self.cuts[k + 1]
        return slice(a, b), self.grams[self.ends[a] : self.ends[b]]


class _Known:
    """What a block knows after some answers: of words and of each order, counts and histories' sums."""

    def __init__(self, row: dict, n: int, orders: int) -> None:
        self.b = b = _Block(row)
        self.n = n
        order, cuts = _split(mixed(b.vocabulary), n)
        self.count, self.number, everywhere = np.zeros(len(b.vocabulary), np.int64), np.zeros(len(b.vocabulary), np.uint64), np.zeros(len(b.vocabulary), np.int64)
        for k, a in _by_part(row["answers1"]).items():
            some = order[cuts[k] : cuts[k + 1]]
            self.count[some] = _filled(a["counts"], len(some))
            everywhere[some] = self.count[some] + _filled(a["held"], len(some))
            self.number[some] = _filled(a["sums"], len(some)) * n + k
        end = int(np.flatnonzero(b.vocabulary == END)[0])
        self.texts, self.all_texts = int(self.count[end]), int(everywhere[end])
        self.named = np.append(self.number, _START)
        self.words, self.keys, self.counts, self.everywhere, self.at = mixed(b.vocabulary), mixed(b.vocabulary), self.count, everywhere, b.tokens
        self.orders: list[tuple[_Order, np.ndarray, np.ndarray]] = []
        for k in range(2, orders + 1):
            o, units = self.next()
            count, everywhere, sums, lacks = o.own.copy(), o.every.copy(), np.zeros((_SUMS, len(units.order)), np.int64), np.zeros(len(units.order), bool)
            for part, a in _by_part(row[f"answers{k}"]).items():
                some, grams = units.part(part)
                count[grams] += _filled(a["counts"], len(grams))
                everywhere[grams] += _filled(a["counts"], len(grams)) + _filled(a["held"], len(grams))
                lacks[some] = _filled(a["lacks"], some.stop - some.start)
                sums[:, some.start + np.flatnonzero(lacks[some])] = _filled(a["sums"], _SUMS * int(lacks[some].sum())).reshape(_SUMS, -1)
            # beside what it was answered, a unit has its n-grams and what it told
            sums += _sums(np.repeat(np.arange(len(units.order)), units.runs), count[units.grams], self.counts[o.lower[units.grams]], len(units.order))
            sums += units.told
            near = np.flatnonzero(units.closed[o.hist])
            whole = _sums(o.hist[near], o.own[near], self.counts[o.lower[near]], len(units.base))
            of = units.of[units.order]
            for j in range(_SUMS):
                some = np.flatnonzero(sums[j])
                np.add.at(whole[j], of[some], sums[j, some])
            self.orders.append((o, count, whole))
            self.keys = mixed(self._history_keys()[o.hist] * _ODD + self.words[o.word])
            self.named = self._pairs(o) if k == 2 else None
            self.counts, self.everywhere, self.at = count, everywhere, o.at

    def _pairs(self, o: _Order) -> np.ndarray:
        """Each bigram, and the start of a text, as a number of 48 bits made of its words' numbers, or _HASHED."""
        first, second = np.append(self.number, _NUMBERED)[o.hist], self.number[o.word]
        large = (second >= _NUMBERED) | (first >= _NUMBERED) & (o.hist < len(self.number))
        return np.append(np.where(large, _HASHED, first << np.uint64(24) | second), _HASHED)

    def _history_keys(self) -> np.ndarray:
        return np.append(self.keys, END + np.uint64(len(self.orders) + 1))

    def next(self) -> tuple[_Order, _Units]:
        """The order after those that are known."""
        o = _Order(self.b, self.at, len(self.counts))
        return o, _Units(o, self._history_keys(), np.append(self.counts, self.texts), np.append(self.everywhere, self.all_texts), self.number, self.n, self.named, not self.orders)


def _by_part(answers: list[dict] | None) -> dict[int, dict]:
    return {a["bucket"]: a for a in answers or []}


def _split(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, cuts): keys by part, stable."""
    part = (key % np.uint64(n)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(part, minlength=n))))


_ASK = "bucket int, block long, keys binary, runs binary, words binary, own binary, held binary, lower binary, told binary, facts binary"
#: Counts and sums are what is beside the block's own and what follows from these; lacks says which units have such sums.
_TELL = "bucket int, block long, counts binary, held binary, lacks binary, sums binary, facts binary"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])


def _in_parts(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), 256):
        yield _batch(schema, rows[a : a + 256])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]
            release()


def _exchange(asked: DataFrame, n: int, answer) -> DataFrame:
    """Deals rows by bucket and gives answer() each bucket's rows in order of block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["bucket"] != row["bucket"]:
                    yield from _in_parts(answer(rows), _TELL)
                    rows = []
                    release()
                rows.append(row)
        if rows:
            yield from _in_parts(answer(rows), _TELL)
        release()

    return asked.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, _TELL)


def _gathered(answers: DataFrame, k: int) -> DataFrame:
    """All answers to a block as one array: as many as there are parts at most, each of a bounded block's size."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts", "held", "lacks", "sums", "facts")).alias(f"answers{k}"))


def ask_words(blocks: DataFrame, n: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            b = _Block(row)
            own = np.bincount(b.tokens[b.trains], minlength=len(b.vocabulary))
            held = np.bincount(b.tokens, minlength=len(b.vocabulary)) - own
            order, cuts = _split(mixed(b.vocabulary), n)
            rows = []
            for k in range(n):
                some = order[cuts[k] : cuts[k + 1]]
                if len(some):
                    rows.append((k, row["block"], b.vocabulary[some].tobytes(), b"", b"", packed(own[some]), packed(held[some]), b"", b"", b""))
            yield from _in_parts(rows, _ASK)

    return blocks.mapInArrow(run, _ASK)


def answer_words(rows: list[dict]) -> list[tuple]:
    """counts are the words' training counts, held all others, and sums their places in the part in order of frequency, which
    number them: frequent words have small numbers."""
    keys = [np.frombuffer(r["keys"], "<u8") for r in rows]
    every, _, at = distinct(np.concatenate(keys))
    total, held = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    np.add.at(total, at, np.concatenate([_filled(r["own"], len(k)) for r, k in zip(rows, keys, strict=True)]))
    np.add.at(held, at, np.concatenate([_filled(r["held"], len(k)) for r, k in zip(rows, keys, strict=True)]))
    place = np.empty(len(every), np.int64)
    place[np.argsort(-total, kind="stable")] = np.arange(len(every))
    facts = _counts_of_counts(total).astype("<i8").tobytes()
    each = np.split(at, np.cumsum([len(k) for k in keys])[:-1])
    return [(r["bucket"], r["block"], packed(total[p]), packed(held[p]), b"", packed(place[p]), None if i else facts) for i, (r, p) in enumerate(zip(rows, each, strict=True))]


def ask_order(known: DataFrame, k: int, n: int, last: bool = False) -> DataFrame:
    """Each block's n-grams of order k that it can't know, by part: keys are the units', in order and as differences; runs how
    many n-grams each has; then of each n-gram its last word's number, its own count in training and beside it (which the last order
    has no use for), and the count of its shorter form: for n-grams of two words, one for each last word; only for those
    that the block has in training, as what is nowhere in training needs none. told are the units' sums of local n-grams,
    and facts the counts of counts of what isn't asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            known = _Known(row, n, k - 1)
            o, units = known.next()
            facts = _counts_of_counts(o.own[units.local]).astype("<i8").tobytes()
            # the block's facts go to some part, with or without units there
            home = row["block"] % n
            rows = []
            for part in range(n):
                some, grams = units.part(part)
                if some.start == some.stop and part != home:
                    continue
                steps = np.diff(units.key[some], prepend=np.uint64(0))
                word, own = known.number[o.word[grams]], o.own[grams]
                lower = known.counts[o.lower[grams[own > 0]]]
                if k == 2:
                    lower = lower[distinct(word[own > 0])[1]]
                numbers = (word, own, own[:0] if last else o.every[grams] - own, lower, units.told[:, some])
                rows.append((part, row["block"], packed(steps), packed(units.runs[some]), *map(packed, numbers), facts if part == home else None))
            yield from _in_parts(rows, _ASK)
            del known, o, units, rows

    return known.mapInArrow(run, _ASK)


def answer_order(rows: list[dict], by_word: bool = False, beside_own: bool = False) -> list[tuple]:
    """by_word: counts of shorter forms come for each last word. beside_own: counts and sums are told without those that the block
    has of its own, which are much smaller numbers; else they are told whole."""
    keys, grams, own, held, lower, every_run, told = [], [], [], [], [], [], []
    for r in rows:
        key = np.cumsum(unpacked(r["keys"]), dtype=np.uint64)
        runs = _filled(r["runs"], len(key))
        m = int(runs.sum())
        word = unpacked(r["words"])
        word = word if len(word) else np.zeros(m, np.uint64)
        keys.append(key)
        every_run.append(runs)
        grams.append(mixed(np.repeat(key, runs) * _ODD + mixed(word)))
        own.append(_filled(r["own"], m))
        held.append(_filled(r["held"], m))
        seen = np.flatnonzero(own[-1])
        at = distinct(word[seen])[2] if by_word else np.arange(len(seen))
        lower.append(_filled(r["lower"], int(at.max(initial=-1)) + 1)[at])
        told.append(_filled(r["told"], _SUMS * len(key)).reshape(_SUMS, -1))
    histories, _, unit = distinct(np.concatenate(keys))
    every, _, at = distinct(np.concatenate(grams))
    total, beside = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    np.add.at(total, at, np.concatenate(own))
    np.add.at(beside, at, np.concatenate(held))
    low, hist = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
    low[at[np.concatenate(own) > 0]] = np.concatenate(lower)
    hist[at] = np.repeat(unit, np.concatenate(every_run))
    sums = _sums(hist, total, low, len(histories))
    for j, row in enumerate(np.concatenate(told, axis=1)):
        some = np.flatnonzero(row)
        np.add.at(sums[j], unit[some], row[some])
    facts = _counts_of_counts(total)
    for r in rows:
        if r["facts"] is not None:
            facts = facts + np.frombuffer(r["facts"], "<i8")
    facts = facts.astype("<i8").tobytes()
    each, units = np.split(at, np.cumsum([len(g) for g in grams])[:-1]), np.split(unit, np.cumsum([len(k) for k in keys])[:-1])
    out = []
    for i, (r, p, u, runs, t, mine, others) in enumerate(zip(rows, each, units, every_run, told, own, held, strict=True)):
        # a block that has met all that follows a unit adds it up by itself
        rest = sums[:, u]
        rest -= _sums(np.repeat(np.arange(len(u)), runs), total[p], low[p], len(u))
        rest -= t
        lacks = rest.any(axis=0)
        numbers = (total[p] - mine, beside[p] - others, lacks, rest[:, lacks]) if beside_own else (total[p], beside[p], lacks, sums[:, u[lacks]])
        out.append((r["bucket"], r["block"], *map(packed, numbers), None if i else facts))
    return out


def _counts_of_counts(total: np.ndarray) -> np.ndarray:
    """n, types and how many have count 1 .. UNDISCOUNTED + 1."""
    kept = total[total > 0]
    return np.concatenate(([kept.sum(), len(kept)], np.bincount(np.minimum(kept, UNDISCOUNTED + 2), minlength=UNDISCOUNTED + 3)[1 : UNDISCOUNTED + 2]))


def discounts(of: np.ndarray) -> np.ndarray:
    """Katz's factor for each count up to UNDISCOUNTED (index 0 unused), from counts of counts 1 .. UNDISCOUNTED + 1.

    Where the Good-Turing estimate isn't usable (a count of counts is zero, or a factor is not in (0, 1]),
    no count is discounted but by the absolute rule n1 / (n1 + 2 n2), spread evenly; with no singles
    nothing is discounted.
    """
    k = UNDISCOUNTED
    n = np.concatenate(([0.0], of.astype(float)))
    d = np.ones(k + 2)
    if n[1] > 0 and (n[1 : k + 2] > 0).all():
        a = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        d[1 : k + 1] = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - a) / (1 - a) if a < 1 else -1
    else:
        d[1] = -1
    if not ((d > 0) & (d <= 1)).all():
        b = n[1] / (n[1] + 2 * n[2]) if n[1] > 0 else 0.0
        r = np.arange(1, k + 1)
        d[1 : k + 1] = (r - min(b, 0.99)) / r
    return d


def _discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    return count * d[np.minimum(count, UNDISCOUNTED + 1)]


class Unigrams:
    """Good-Turing unigram probabilities. What discounting frees goes to one further word: all unseen ones.

    They are normalised: the seen words' and the unseen word's probabilities add up to 1.
    """

    def __init__(self, facts: np.ndarray) -> None:
        self.n, self.types = int(facts[0]), int(facts[1])
        self.d = discounts(facts[2:])
        mass = 0.0
        if self.n:
            few = np.arange(1, UNDISCOUNTED + 1)
            mass = float((facts[2 : 2 + UNDISCOUNTED] * few * (1 - self.d[1 : UNDISCOUNTED + 1])).sum()) / self.n
        # with nothing to free, the unseen word counts as one more token
        self.scale = 1.0 if mass > 0 else self.n / (self.n + 1)
        self.unseen = mass if mass > 0 else 1 / (self.n + 1)

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, _discounted(count, self.d) / max(self.n, 1) * self.scale, self.unseen)


def order_weights(sums: np.ndarray, d: np.ndarray, seen_low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens after each history, backoff weight): what the seen next words leave, over what they leave of the
    lower order. A history that leaves nothing sets one token aside, and its seen words shrink to make room."""
    few = np.arange(1, UNDISCOUNTED + 1)[:, None]
    tokens = (sums[:UNDISCOUNTED] * few).sum(axis=0) + sums[UNDISCOUNTED]
    kept = (sums[:UNDISCOUNTED] * few * d[1 : UNDISCOUNTED + 1, None]).sum(axis=0) + sums[UNDISCOUNTED]
    left = 1 - kept / np.maximum(tokens, 1)
    none = left <= 1e-12
    return np.where(none, tokens + 1, tokens), np.where(none, 1 / (tokens + 1), left) / np.maximum(1 - seen_low, 1e-12)


def probabilities(known: _Known, unigrams: Unigrams, d: list[np.ndarray]) -> np.ndarray:
    """The probability of each token of a block, by recursion from words to the highest order."""
    p, total = unigrams.probability(known.count), None
    for k, (o, count, sums) in enumerate(known.orders):
        few = np.arange(1, UNDISCOUNTED + 1)
        by_low = sums[UNDISCOUNTED + 1 :]
        if k == 0:
            weight, over = unigrams.probability(few), unigrams.n / unigrams.scale if unigrams.n else 1.0
        else:
            # the shorter history of each history; that of the start is the start
            below = known.orders[k - 1][0]
            weight, over = few * d[k - 1][1 : UNDISCOUNTED + 1], np.maximum(total[np.append(below.lower, len(total) - 1)], 1)
        low = (by_low[:UNDISCOUNTED] * weight[:, None]).sum(axis=0)
        seen_low = low + by_low[UNDISCOUNTED] / over if k == 0 else (low + by_low[UNDISCOUNTED]) / over
        total, alpha = order_weights(sums, d[k], seen_low)
        p = np.where(count > 0, _discounted(count, d[k]) / np.maximum(total[o.hist], 1), alpha[o.hist] * p[o.lower])
    return p[known.at]


def score(docs: DataFrame, modulus: int = 7, remainder: int = 2, order: int = ORDER, parts: int | None = None) -> DataFrame:
    """Scores all documents by a Katz model of n-grams up to order, learnt from those with crc32(doc_id) mod modulus
    other than remainder.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10). Tokens are
    words with A-Z lower-cased and an end for each text; histories reach back to the start of a text. A null or empty
    text has the end alone. Rows with null doc_id are scored, not held out, and not learnt from.
    With no training token at all every token has the unseen word's probability 1. Repeated rows count
    each. Texts of any length are scored whole; other columns are ignored; an empty table gives an empty result.
    Words and histories are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    blocks = token_blocks(docs, modulus, remainder)
    tokens = blocks.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).head()[0]
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 24, -(-tokens // BUCKET_TOKENS))
    known, facts = blocks, []
    for k in range(1, order + 1):
        if k == 1:
            told = _exchange(ask_words(blocks, n), n, answer_words)
        else:
            told = _exchange(ask_order(known, k, n, k == order), n, partial(answer_order, by_word=k == 2, beside_own=True))
        if k < order:
            # in buckets by block, as the blocks are: what comes later joins them without moving either
            told = stored_by(_gathered(told, k), f"answers{k}", "block")
            facts.append(_sum_facts(told.select(F.explode(f"answers{k}.facts").alias("facts"))))
        else:
            told = stored(told, f"answers{k}", "uncompressed")
            facts.append(_sum_facts(told))
            told = _gathered(told, k)
        free_shuffles(spark)
        known = known.join(told, "block", "left")
    unigrams, d = Unigrams(facts[0]), [discounts(f[2:]) for f in facts[1:]]

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            known = _Known(row, n, order)
            b, log = known.b, np.log10(probabilities(known, unigrams, d))
            base = np.log10((known.count + 1) / (unigrams.n + unigrams.types + 1))
            sums = lambda x: np.add.reduceat(x, b.first)  # noqa: B023, E731  every text has a token
            values = {"doc_id": pa.array(b.ids, pa.int64(), mask=b.part == NO_ID), "held_out": b.part == HELD_OUT, "n_tokens": b.sizes, "n_known": sums((known.count > 0)[b.tokens].astype(np.int64)), "train_tokens": np.full(len(b.ids), unigrams.n)}
            yield pa.RecordBatch.from_pydict({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in (values | {"base_score": sums(base[b.tokens]), "score": sums(log)}).items()})
            del known, b, log

    return known.mapInArrow(evaluate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _sum_facts(answers: DataFrame) -> np.ndarray:
    """Sums the partitions' counts of counts: one short row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(UNDISCOUNTED + 3, np.int64)
        for batch in batches:
            for x in batch.column("facts").to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(total)), pa.int32()), "v": pa.array(total, pa.int64())})

    rows = answers.where("facts is not null").select("facts").mapInArrow(run, "k int, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(UNDISCOUNTED + 3, np.int64)
    for r in rows:
        total[r["k"]] = r["v"]
    return total
