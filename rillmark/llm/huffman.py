"""Token ids in binary files: canonical length-limited Huffman codes with checkpoints.

1. Documents become blocks of words: hashes and texts of a block's distinct words, and each word's place
   among them.
2. Blocks send their distinct words to partitions by hash, with counts. There each word is encoded once, with the
   tokenizers library; the counts of ids of the whole corpus come out on the way.
3. Package-merge gives code lengths (at most 16 bits), hence canonical codes. Blocks turn their words into ids and
   ids into bits, a document beginning at a whole byte.
4. Coded documents are dealt by ranges of their id and written in ascending order, file after file, in blocks that
   hold, for every STRIDE-th id of a document, the bit offset where it begins. The code lengths are a file of the set.

Decoding needs the files alone. It looks up 16 bits at a time in one table, all checkpoints of a block side by side; blocks are
independent.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillmark.llm.bpe import LibraryEncoder, encoder, read_spec
from rillmark.llm.common import distinct, flat, free_shuffles, mixed, pieces, release, small_batches, stored, stored_by, word_spans, work_path

LONGEST = 16
#: Ids of a file's block, ids between checkpoints, text bytes of a block of words, and words that a partition stands for.
BLOCK_IDS, STRIDE, BLOCK_BYTES, BUCKET_WORDS = 1 << 17, 128, 5 << 20, 2 << 20
END_ID = 1
#: Of the files' layout; decode() refuses others.
VERSION = 1


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most longest bits, by package-merge; 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} ids need more than {longest} bits")
    weight = np.sort(counts[used].astype(np.int64), kind="stable")
    order = used[np.argsort(counts[used], kind="stable")]
    # each level's list: the leaves merged with the pairs of the level before
    levels, row = [], weight
    leaf = np.ones(len(weight), bool)
    for _ in range(longest):
        levels.append(leaf)
        packed = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate((weight, packed))
        at = np.argsort(both, kind="stable")
        row, leaf = both[at], at < len(weight)
    # the cheapest 2n - 2 items of the last full level; pairs among them open the level before
    take, total = 2 * len(used) - 2, np.zeros(len(used), np.int64)
    for leaf in reversed(levels):
        chosen = leaf[:take]
        n = int(chosen.sum())
        total[:n] += 1
        take = 2 * (len(chosen) - n)
    lengths[order] = total
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        span = np.uint64(1) << (np.uint64(32) - lengths[order].astype(np.uint64))
        left = np.concatenate(([np.uint64(0)], np.cumsum(span)[:-1]))
        codes[order] = (left >> (np.uint64(32) - lengths[order].astype(np.uint64))).astype(np.uint32)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit window: the id that it begins with, and its bits (0: no code)."""
    codes = canonical(lengths).astype(np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    reach = 1 << (LONGEST - lengths[order].astype(np.int64))
    symbol, bits = np.zeros(1 << LONGEST, np.uint32), np.zeros(1 << LONGEST, np.int64)
    if len(order):
        at = np.repeat(codes[order] << (LONGEST - lengths[order].astype(np.int64)), reach)
        at += np.arange(len(at)) - np.repeat(np.cumsum(reach) - reach, reach)
        symbol[at], bits[at] = np.repeat(order, reach), np.repeat(lengths[order], reach)
    return symbol, bits


def encode_texts(ids: np.ndarray, counts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> list[tuple[bytes, bytes]]:
    """(bits, checkpoints) of each text: its codes end to end from a whole byte, high bit first, and the 32-bit
    offsets of each STRIDE-th id from its first bit. counts are the texts' numbers of ids."""
    if not len(ids):
        return [(b"", b"")] * len(counts)
    size = lengths[ids].astype(np.int64)
    if not size.all():
        raise ValueError("an id without a code")
    total = np.concatenate(([0], np.cumsum(size)))
    first = np.cumsum(counts) - counts
    used = total[first + counts] - total[first]
    whole = (used + 7) >> 3
    base = 8 * (np.cumsum(whole) - whole)
    inside = total[:-1] - np.repeat(total[first], counts)
    begin = inside + np.repeat(base, counts)
    word = begin >> 5
    # a code of at most 16 bits touches its 32-bit word and perhaps the next
    value = codes[ids].astype(np.uint64) << (64 - size - (begin & 31)).astype(np.uint64)
    out = np.zeros(int(base[-1] + 8 * whole[-1] + 31 >> 5) + 1, np.uint64)
    new = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[new]] += np.add.reduceat(value >> np.uint64(32), new)
    out[word[new] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), new)
    data = out.astype(">u4").tobytes()
    marks = inside.astype("<u4")
    cuts = zip((base >> 3).tolist(), whole.tolist(), first.tolist(), counts.tolist(), strict=True)
    return [(data[b : b + w], marks[f : f + n : STRIDE].tobytes()) for b, w, f, n in cuts]


def decode_texts(bits: bytes, checkpoints: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block of texts; all checkpoints are decoded side by side.

    checkpoints are bit offsets in bits, of every STRIDE-th id of each text; counts the texts' numbers of ids.
    """
    lanes = -(-counts // STRIDE)
    take = np.full(len(checkpoints), STRIDE)
    last = np.cumsum(lanes)[lanes > 0] - 1
    take[last] = (counts - STRIDE * (lanes - 1))[lanes > 0]
    # the longest first, so that those still at work are always a prefix
    order = np.argsort(-take, kind="stable")
    at, live = checkpoints[order].astype(np.int64), np.searchsorted(-take[order], -np.arange(STRIDE), "left")
    symbol, width = table
    data = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    three = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    out = np.empty((len(at), STRIDE), np.uint32)
    for k in range(STRIDE):
        n = live[k]
        if not n:
            break
        now = at[:n]
        window = (three[now >> 3] >> (8 - (now & 7)).astype(np.uint32)) & np.uint32(0xFFFF)
        out[:n, k] = symbol[window]
        now += width[window]
    back = np.empty_like(out)
    back[order] = out
    return back[np.arange(STRIDE) < take[:, None]]


_ZSTD: dict[str, object] = {}


def _press(data: bytes) -> bytes:
    import zstandard

    return _ZSTD.setdefault("c", zstandard.ZstdCompressor(level=3)).compress(data)


def _unpress(data: bytes) -> bytes:
    import zstandard

    return _ZSTD.setdefault("d", zstandard.ZstdDecompressor()).decompress(data)


_NO_ID = -(2**63)
_LT, _BAR = np.uint8(60), np.uint8(124)

#: ids and sizes (words of each text) are 64-bit, texts the distinct words in order of hash with a space between
#: (zstd), tokens 32-bit places among them (zstd). Hashes are made again from the texts: they don't compress.
_WORDS = "block long, n_docs long, n_words long, ids binary, sizes binary, texts binary, tokens binary"


def _by_case(data: np.ndarray, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes that tell words which may hold a special token apart in their own case."""
    pair = np.flatnonzero((data[:-1] == _LT) & (data[1:] == _BAR)) if len(data) > 1 else np.zeros(0, int)
    for w in np.unique(np.searchsorted(begin, pair, "right") - 1).tolist() if len(pair) else []:
        word = data[begin[w] : end[w]].tobytes()
        hashes[w] = mixed(np.array([zlib.crc32(word), len(word)], np.uint64) + np.uint64(2**40)).sum()
    return hashes


def _vocabulary(texts: bytes) -> np.ndarray:
    """The hashes of words with a space between."""
    data = np.frombuffer(texts, np.uint8)
    hashes, _, begin, end = word_spans(data, np.array([0, len(data)]))
    return _by_case(data, hashes, begin, end)


def word_blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents as blocks of words, split at ASCII white space and told apart with A-Z lower-cased, as the
    vocabulary does. A word that may hold a special token is told apart in its own case."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, ...]] = []

        def out() -> pa.RecordBatch:
            nonlocal held, number, size
            data = np.concatenate([h[0] for h in held])
            base = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
            hashes, begin, end = (np.concatenate([h[i] + (b if i > 3 else 0) for h, b in zip(held, base, strict=True)]) for i in (3, 4, 5))
            raw = data.tobytes()
            _, first, tokens = distinct(_by_case(data, hashes, begin, end))
            texts = b" ".join([raw[a:b] for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True)])
            ids, count = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            row = (part << 32 | number, len(ids), len(tokens), ids.tobytes(), count.tobytes(), _press(texts), _press(tokens.astype("<u4").tobytes()))
            held, size, number = [], 0, number + 1
            return pa.RecordBatch.from_arrays(
                [pa.array([x], k) for x, k in zip(row, (*[pa.int64()] * 3, *[pa.binary()] * 4), strict=True)], names=[c.split(" ")[0] for c in _WORDS.split(", ")]
            )

        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                data, offsets = flat(batch.column("text"))
                hashes, starts, begin, end = word_spans(data, offsets)
                ids = batch.column("id").fill_null(_NO_ID).to_numpy(zero_copy_only=False).astype("<i8")
                held.append((data, ids, np.diff(starts).astype("<i8"), hashes, begin, end))
                size += len(data)
                if size >= BLOCK_BYTES:
                    yield out()
                    release()
        if held:
            yield out()
        release()

    return stored_by(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")).mapInArrow(run, _WORDS), "words", "block")


def _ragged(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs values[begin : begin + size], end to end."""
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return values[np.repeat(begin, size) + step]


def _split(vocabulary: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    part = (mixed(vocabulary) % np.uint64(n)).astype(np.int64)
    return np.argsort(part, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(part, minlength=n))))


def encoded_words(blocks: DataFrame, tokenizer_path: str, n: int) -> DataFrame:
    """The ids of each block's words: (bucket, block, sizes, ids, counts). A bucket's first row has the counts of the ids
    of all its words, in all texts, as pairs of 64-bit numbers."""
    spec = blocks.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = _unpress(row["texts"])
                vocabulary = _vocabulary(raw)
                if not len(vocabulary):
                    continue
                texts = raw.split(b" ")
                count = np.bincount(np.frombuffer(_unpress(row["tokens"]), "<u4"), minlength=len(vocabulary))
                order, cuts = _split(vocabulary, n)
                for k in range(n):
                    some = order[cuts[k] : cuts[k + 1]]
                    if len(some):
                        values = (k, row["block"], _press(b" ".join([texts[i] for i in some.tolist()])), _press(count[some].astype("<u4").tobytes()))
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), *[pa.binary()] * 2), strict=True)], names=["bucket", "block", "texts", "counts"])
            release()

    def answer(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value, LibraryEncoder)
        sent = [_unpress(r["texts"]) for r in rows]
        keys = [*map(_vocabulary, sent)]
        every, first, at = distinct(np.concatenate(keys))
        texts = [w for x in sent for w in x.split(b" ")]
        own = [texts[i].decode() for i in first.tolist()]
        made = bpe.encode_words(own)
        coded = [made[w] for w in own]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        ids = np.frombuffer(b"".join(coded), "<u4")
        begin = np.cumsum(size) - size
        total = np.bincount(at, weights=np.concatenate([np.frombuffer(_unpress(r["counts"]), "<u4") for r in rows]), minlength=len(every))
        per_id = np.bincount(ids, weights=np.repeat(total, size)).astype(np.int64)
        seen = np.flatnonzero(per_id)
        counts = np.concatenate((seen, per_id[seen])).astype("<i8").tobytes()
        for k, (r, a) in enumerate(zip(rows, np.split(at, np.cumsum([len(x) for x in keys])[:-1]), strict=True)):
            values = (r["bucket"], r["block"], _press(size[a].astype("<u4").tobytes()), _press(_ragged(ids, begin[a], size[a]).astype("<u4").tobytes()), None if k else counts)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int32(), pa.int64(), *[pa.binary()] * 3), strict=True)], names=["bucket", "block", "sizes", "ids", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and rows[0]["bucket"] != row["bucket"]:
                    yield from answer(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield from answer(rows)
        release()

    asked = blocks.select("block", "texts", "tokens").mapInArrow(ask, "bucket int, block long, texts binary, counts binary")
    told = asked.repartition(n, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "bucket int, block long, sizes binary, ids binary, counts binary")
    made = stored(told, "word-ids", "uncompressed")
    free_shuffles(blocks.sparkSession)
    return made


def global_counts(words: DataFrame, vocabulary: int, documents: int, end_id: int) -> np.ndarray:
    """How often each id occurs in the whole corpus, ends included: summed by id, vocabulary entries at the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("counts").to_pylist():
                ids, n = np.frombuffer(data, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int32()), "n": pa.array(n, pa.int64())})

    rows = words.where("counts is not null").select("counts").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[rows["id"].to_numpy(int)] = rows["n"].to_numpy(np.int64)
    out[end_id] += documents
    return out


def coded_documents(blocks: DataFrame, words: DataFrame, lengths: np.ndarray, bounds: list[int], end_id: int, n: int) -> DataFrame:
    """Each document's bits: part, doc_id, n_ids, bits, checkpoints. part is the place of doc_id among the bounds, which may
    repeat."""
    table = blocks.sparkSession.sparkContext.broadcast(lengths.tobytes())
    limits = np.array(bounds, np.int64)

    def part_of(doc: np.ndarray, block: int) -> np.ndarray:
        # an id that bounds name may end the part before them, fill those between and begin the one after; its rows share them
        low, high = np.searchsorted(limits, doc, "left"), np.searchsorted(limits, doc, "right")
        spread = mixed(np.arange(len(doc), dtype=np.uint64) + np.uint64(block)) % (high - low + 1).astype(np.uint64)
        return low + spread.astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_of = np.frombuffer(table.value, np.uint8)
        codes = canonical(size_of)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                vocabulary = _vocabulary(_unpress(row["texts"]))
                order, cuts = _split(vocabulary, n)
                size, parts = np.zeros(len(vocabulary), np.int64), []
                begin, filled = np.zeros(len(vocabulary), np.int64), 0
                for a in row["answers"] or []:
                    some = order[cuts[a["bucket"]] : cuts[a["bucket"] + 1]]
                    got = np.frombuffer(_unpress(a["sizes"]), "<u4").astype(np.int64)
                    size[some], begin[some] = got, filled + np.cumsum(got) - got
                    parts.append(np.frombuffer(_unpress(a["ids"]), "<u4"))
                    filled += len(parts[-1])
                # the end is one word more, after those of the block
                ids_of = np.concatenate([*parts, np.array([end_id], "<u4")])
                size, begin = np.append(size, 1), np.append(begin, filled)
                count = np.frombuffer(row["sizes"], "<i8")
                tokens = np.insert(np.frombuffer(_unpress(row["tokens"]), "<u4").astype(np.int64), np.cumsum(count), len(vocabulary))
                cut = np.cumsum(count + 1)
                so_far = np.concatenate(([0], np.cumsum(size[tokens])))
                n_ids = np.diff(so_far[np.concatenate(([0], cut))])
                made = encode_texts(_ragged(ids_of, begin[tokens], size[tokens]), n_ids, size_of, codes)
                doc = np.frombuffer(row["ids"], "<i8")
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(part_of(doc, row["block"]), pa.int32()),
                        "doc_id": pa.array(doc, pa.int64(), mask=doc == _NO_ID),
                        "n_ids": pa.array(n_ids, pa.int64()),
                        "bits": pa.array([b for b, _ in made], pa.binary()),
                        "checkpoints": pa.array([c for _, c in made], pa.binary()),
                    }
                )
                del made, tokens, so_far
                release()

    answers = words.groupBy("block").agg(F.collect_list(F.struct("bucket", "sizes", "ids")).alias("answers"))
    ready = blocks.select("block", "ids", "sizes", "texts", "tokens").join(answers, "block", "left")
    return ready.mapInArrow(run, "part int, doc_id long, n_ids long, bits binary, checkpoints binary")


#: A file's rows. doc_ids and pieces (ids of each document) are 64-bit; checkpoints 64-bit offsets in bits.
BLOCK = "part int, block int, n_ids long, doc_ids binary, pieces binary, bits binary, checkpoints binary"


def write_files(coded: DataFrame, parts: int, path: str) -> None:
    """Writes coded documents in ascending doc_id, null ids first, also over the files in order of name. A row is a block of
    about BLOCK_IDS ids; a document lies in one block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, held, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, block
            width = np.array([len(h[2]) for h in held], np.int64)
            base = 8 * (np.cumsum(width) - width)
            marks = [np.frombuffer(h[3], "<u4").astype("<i8") + b for h, b in zip(held, base.tolist(), strict=True)]
            row = (part, block, size, np.array([h[0] for h in held], "<i8").tobytes(), np.array([h[1] for h in held], "<i8").tobytes(), b"".join([h[2] for h in held]), np.concatenate(marks).tobytes())
            held, size, block = [], 0, block + 1
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4), strict=True)], names=[c.split(" ")[0] for c in BLOCK.split(", ")])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (r[0] != part or size >= BLOCK_IDS):
                    yield out()
                if r[0] != part:
                    part, block = r[0], 0
                held.append((_NO_ID if r[1] is None else r[1], *r[2:]))
                size += r[2]
        if held:
            yield out()
        release()

    dealt = coded.repartitionById(parts, "part").sortWithinPartitions("part", "doc_id")
    dealt.mapInArrow(run, BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def write_codes(spark: SparkSession, path: str, lengths: np.ndarray) -> None:
    row = (VERSION, LONGEST, STRIDE, bytearray(lengths.astype(np.uint8).tobytes()))
    spark.createDataFrame([row], "version int, longest int, stride int, lengths binary").coalesce(1).write.parquet(f"{path}/codes")


def read_files(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    """(the blocks' table, the code lengths) of a set of files; the lengths are as many as the vocabulary's ids."""
    codes = spark.read.parquet(f"{path}/codes").head()
    if (codes.version, codes.longest, codes.stride) != (VERSION, LONGEST, STRIDE):
        raise ValueError(f"{path}: version {codes.version}, codes of {codes.longest} bits, a checkpoint every {codes.stride} ids")
    return spark.read.schema(BLOCK).parquet(f"{path}/blocks"), bytes(codes.lengths)


def decode(spark: SparkSession, path: str) -> DataFrame:
    """Reads files back, by themselves: a row (part, block, doc_id, before, n_ids, ids) for each document. before counts the
    block's ids ahead of it; ids are little-endian unsigned 32-bit integers."""
    files, lengths = read_files(spark, path)
    table = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decode_table(np.frombuffer(table.value, np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                yield _documents(row, lookup, False)

    return files.mapInArrow(run, "part int, block int, doc_id long, before long, n_ids long, ids binary")


def _documents(row: dict, lookup: tuple[np.ndarray, np.ndarray], digest: bool) -> pa.RecordBatch:
    size, doc = np.frombuffer(row["pieces"], "<i8"), np.frombuffer(row["doc_ids"], "<i8")
    data = decode_texts(row["bits"], np.frombuffer(row["checkpoints"], "<i8"), size, lookup).astype("<u4").tobytes()
    end = np.cumsum(size)
    each = [data[4 * (b - n) : 4 * b] for b, n in zip(end.tolist(), size.tolist(), strict=True)]
    last = {"ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64())} if digest else {"ids": pa.array(each, pa.binary())}
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(np.full(len(doc), row["part"]), pa.int32()),
            "block": pa.array(np.full(len(doc), row["block"]), pa.int32()),
            "doc_id": pa.array(doc, pa.int64(), mask=doc == _NO_ID),
            "before": pa.array(end - size, pa.int64()),
            "n_ids": pa.array(size, pa.int64()),
            **last,
        }
    )


def write_corpus(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> str:
    """Encodes and writes a corpus to path, else to the shared folder; returns where. decode() reads it.

    Null and empty texts have the end id alone, which follows each document. Repeated rows have a place each, side by
    side. Null ids come first. Texts of any length are written whole, other columns are ignored, and an empty
    table gives files without blocks. Rows of one id that are many are shared among parts.
    """
    import json

    spark = docs.sparkSession
    path = path or work_path(spark, "huffman")
    spec = json.loads(read_spec(tokenizer_path))
    vocabulary = 1 + max(*spec["model"]["vocab"].values(), *(x["id"] for x in spec["added_tokens"]), end_id)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    blocks = word_blocks(docs, id_column, text_column)
    sizes = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("words")).head()
    buckets = max(parts, -(-sizes.words // BUCKET_WORDS))
    words = encoded_words(blocks, tokenizer_path, buckets)
    lengths = code_lengths(global_counts(words, vocabulary, sizes.docs, end_id))
    write_codes(spark, path, lengths)
    # limits of the parts: quantiles of the ids, as many as there are partitions
    ids = F.coalesce(F.col(id_column).cast("long"), F.lit(_NO_ID))
    bounds = docs.agg(F.percentile_approx(ids, [k / parts for k in range(1, parts)], 20 * parts)).head()[0] or []
    write_files(coded_documents(blocks, words, lengths, bounds, end_id, buckets), parts, path)
    return path


def roundtrip(docs: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the corpus' ids and reads the files back: doc_id, start, n_tokens, ids_crc32.

    start is the number of ids of all documents before it in ascending doc_id; n_tokens counts the end id. The
    sums run over blocks within a part by a window, and over all parts, of which there are as many as
    partitions, by another. For nulls, repeated rows, long texts and empty tables see write_corpus().
    """
    spark = docs.sparkSession
    files, lengths = read_files(spark, write_corpus(docs, tokenizer_path, None, end_id))
    table = spark.sparkContext.broadcast(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = decode_table(np.frombuffer(table.value, np.uint8))
        for batch in batches:
            for row in batch.to_pylist():
                yield _documents(row, lookup, True)
        release()

    rows = files.mapInArrow(run, "part int, block int, doc_id long, before long, n_ids long, ids_crc32 long")
    totals = files.select("part", "block", "n_ids")
    inner = totals.select("part", "block", (F.sum("n_ids").over(Window.partitionBy("part").orderBy("block")) - F.col("n_ids")).alias("in_part"))
    each = totals.groupBy("part").agg(F.sum("n_ids").alias("t")).select("part", (F.sum("t").over(Window.orderBy("part")) - F.col("t")).alias("base"))
    placed = rows.join(inner.join(each, "part"), ["part", "block"])
    return placed.select("doc_id", (F.col("base") + F.col("in_part") + F.col("before")).alias("start"), F.col("n_ids").alias("n_tokens"), "ids_crc32")
