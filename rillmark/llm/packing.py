"""Best-fit packing of token ids into sequences of several permitted lengths.

Documents are encoded, an end id follows each, and what is longer than the largest length is cut into pieces.
Pieces are dealt evenly over groups by a hash of their document, place, contents and number among equal rows, whatever their
source and however the input is split, and each group is packed by itself, longest piece first: a piece goes into the open
bin that it leaves least room in. If none has room, the bin size that costs least is opened: its fixed
overhead and what the rest of the group can't fill, by token that is held. At the end each bin shrinks to the
least permitted length that holds its contents, and is written as a sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillmark.llm.bpe import LibraryEncoder, encoder, read_spec
from rillmark.llm.common import pieces, ragged, release, small_batches, stored, work_path

CAPACITIES = (512, 1024, 2048, 4096)
#: Tokens that a bin costs besides its length.
OVERHEAD = 16
#: Text bytes, or tokens where lengths are given, that a group has about; and tokens that are packed at once at most.
GROUP_BYTES, GROUP_TOKENS, MOST_TOKENS = 512 << 10, 192 << 10, 4 << 20
#: Text bytes that are encoded at once, about.
ENCODED_BYTES = 1 << 20
END_ID = 1


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, its final capacity) of each piece; lengths are 1 to the largest capacity.

    Best fit, longest first, equal lengths in the order given.
    """
    sizes = sorted(set(capacities))
    order = np.argsort(-lengths, kind="stable")
    # volume of the pieces up to each length that are still to come, to judge what a rest can be filled with
    volume = np.bincount(lengths, weights=lengths, minlength=sizes[-1] + 1).astype(np.int64)
    tree = np.zeros(sizes[-1] + 2, np.int64).tolist()

    def add(i: int, v: int) -> None:
        while i < len(tree):
            tree[i] += v
            i += i & -i

    def below(i: int) -> int:
        total = 0
        while i > 0:
            total += tree[i]
            i &= i - 1
        return total

    for i in np.flatnonzero(volume).tolist():
        add(i, int(volume[i]))
    open_: dict[int, list[int]] = {}
    rooms = 0  # bit r is set while a bin has room r
    filled: list[int] = []
    room_of: list[int] = []
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in order.tolist():
        n = int(lengths[i])
        add(n, -n)
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms &= ~(1 << room)
        else:
            waste = {c: c - n - min(c - n, below(c - n)) for c in sizes if c >= n}
            room = min(waste, key=lambda c: ((overhead + waste[c]) / (c - waste[c]), -c))
            b = len(filled)
            filled.append(0)
            room_of.append(room)
        bin_of[i], offset[i] = b, filled[b]
        filled[b] += n
        rest = room - n
        open_.setdefault(rest, []).append(b)
        if rest:
            rooms |= 1 << rest
    steps = np.array(sizes)
    final = steps[np.searchsorted(steps, np.array(filled, np.int64))] if filled else np.zeros(0, np.int64)
    return bin_of, offset, final[bin_of] if filled else final


def _groups(rows: DataFrame, total: int, size: int, key: list[str]) -> DataFrame:
    """Deals rows by group and sorts each group, longest first."""
    groups = max(1, -(-total // size))
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(*key), F.lit(groups)))
    parts = max(1, min(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return dealt.repartition(parts, "g").sortWithinPartitions("g", F.desc("length"), *key)


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(group, chunk, rows): a group's rows, in chunks of MOST_TOKENS should it have more."""
    held: list[pa.RecordBatch] = []
    group, chunk, size = None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        g, n = batch.column("g").to_numpy(), batch.column("length").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (group != int(g[a]) or size > MOST_TOKENS):
                yield group, chunk, pa.Table.from_batches(held).combine_chunks()
                chunk = chunk + 1 if group == int(g[a]) else 0
                held, size = [], 0
            group = int(g[a])
            held.append(batch.slice(a, z - a))
            size += int(n[a:z].sum())
    if held:
        yield group, chunk, pa.Table.from_batches(held).combine_chunks()


def _bin_ids(group: int, chunk: int, bins: np.ndarray) -> np.ndarray:
    """Ids of a chunk's bins: 28 bits of group, 17 of chunk, 18 of bin."""
    if group >= 1 << 28 or chunk >= 1 << 17 or (len(bins) and int(bins.max()) >= 1 << 18):
        raise ValueError("more groups, chunks or bins than a bin_id can tell apart: pack in larger groups")
    return (group << 35) + (chunk << 18) + bins


def best_fit(docs: DataFrame, length: Column, capacities: tuple[int, ...] = CAPACITIES, group_tokens: int = GROUP_TOKENS, id_column: str = "doc_id") -> DataFrame:
    """Packs documents by a length that is given: doc_id, piece, start, length, bin_id, bin_offset, capacity.

    length is a document's tokens; null counts as 0, and a document of 0 tokens has no piece but one of
    length 0 (bin_id null), so that no document is lost. A document longer than the largest capacity is
    cut into pieces of that capacity, which fill a bin each, and a rest. Repeated rows and null ids are
    packed as rows; other columns are ignored; an empty table gives an empty result. bin_id is unique over groups.
    Only ids and lengths are shuffled.
    """
    most = max(capacities)
    n = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(0).cast("long"))
    items = docs.select(F.col(id_column).cast("long").alias("doc_id"), n.alias("n"))
    # equal rows are numbered, so that they are dealt to all groups
    each = _each_copy(items.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("copies")))
    cut = each.select("doc_id", "n", "copy", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest((F.col("n") - 1).cast("long"), F.lit(0).cast("long")), F.lit(most).cast("long"))).alias("start"))
    cut = cut.select("doc_id", "copy", (F.col("start") / most).cast("int").alias("piece"), "start", F.least(F.lit(most).cast("long"), F.col("n") - F.col("start")).alias("length"))
    total = items.agg(F.coalesce(F.sum(F.greatest("n", F.lit(1))), F.lit(0))).head()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, chunk, t in _by_group(batches):
            length = t["length"].to_numpy()
            some = length > 0
            b, offset, capacity = pack(length[some], capacities)
            full = lambda x: pa.array(_spread(x, some), pa.int64(), mask=~some)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [t[c].combine_chunks() for c in ("doc_id", "piece", "start", "length")] + [full(_bin_ids(group, chunk, b)), full(offset), full(capacity)],
                names=["doc_id", "piece", "start", "length", "bin_id", "bin_offset", "capacity"],
            )

    spread = _groups(cut, total, group_tokens, ["doc_id", "start", "length", "copy"])
    return spread.mapInArrow(run, "doc_id long, piece int, start long, length long, bin_id long, bin_offset long, capacity long")


def _spread(values: np.ndarray, where: np.ndarray) -> np.ndarray:
    out = np.zeros(len(where), np.int64)
    out[where] = values
    return out


def _each_copy(rows: DataFrame) -> DataFrame:
    """A row for each of copies equal rows, numbered by copy."""
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")


def _counted(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, text and copies: equal rows are one. Only hashes are shuffled, and of texts those that repeat."""
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("_k", F.xxhash64("id", "text", F.col("id").isNull(), F.col("text").isNull()))
    again = stored(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_k"), "repeated")
    one = F.lit(1).cast("long").alias("copies")
    if again.isEmpty():
        return rows.select("id", "text", one)
    more = rows.join(again, "_k", "left_semi").groupBy("id", "text").agg(F.count(F.lit(1)).alias("copies"))
    return rows.join(again, "_k", "left_anti").select("id", "text", one).union(more)


def token_pieces(docs: DataFrame, tokenizer_path: str, most: int, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, start, length and ids of each document's pieces of at most most ids, and copy, a number from 1 among equal rows of
    docs. ids are little-endian, of 16 bits if the vocabulary has no more, else of 32."""
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    kinds = "doc_id long, start long, length long, ids binary, copies long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value, LibraryEncoder)
        kind = id_kind(bpe.library.get_vocab_size(with_added_tokens=True), end_id)
        for whole in batches:
            for batch in pieces(whole, "text", ENCODED_BYTES):
                ids, offsets = bpe.encode_flat(batch.column("text"))
                ids = np.insert(ids, offsets[1:], end_id).astype(kind)
                n = np.diff(offsets) + 1
                # of each piece: its row, its start in the text, and its end among all ids
                row = np.repeat(np.arange(len(n)), -(-n // most))
                start = most * ragged(np.zeros(len(n), np.int64), -(-n // most))
                length = np.minimum(most, n[row] - start)
                ends = np.concatenate(([0], np.cumsum(length)))
                for a in range(0, len(row), 1024):
                    some = slice(a, a + 1024)
                    cuts = ends[a : a + 1025]
                    data = pa.py_buffer(np.ascontiguousarray(ids[cuts[0] : cuts[-1]]))
                    places = pa.py_buffer(((cuts - cuts[0]) * ids.itemsize).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").take(pa.array(row[some])), pa.array(start[some]), pa.array(length[some]), pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, places, data]), batch.column("copies").take(pa.array(row[some]))],
                        names=["doc_id", "start", "length", "ids", "copies"],
                    )
        release()

    return _each_copy(_counted(docs, id_column, text_column).mapInArrow(run, kinds))


def id_kind(vocabulary: int, end_id: int) -> str:
    return "<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4"


def pack_sequences(docs: DataFrame, tokenizer_path: str, capacities: tuple[int, ...] = CAPACITIES, path: str | None = None, group_bytes: int = GROUP_BYTES, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encodes documents, packs them, writes the sequences as Parquet to path (else to the shared folder) and reads them.

    A row is a sequence: bin_id, capacity (its permitted length), n_tokens, ids (binary: the pieces' ids end to end;
    see token_pieces), and of each piece doc_ids, starts (in its document) and lengths. An empty or null text has the end
    id alone. Repeated rows and null ids are packed as rows. Other columns are ignored; an empty table gives
    no sequence. A document of any length is cut into pieces of the largest capacity and a rest. The same rows in any
    order give the same sequences.
    """
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(text_column), F.lit(0)) + 1), F.lit(0))).head()[0]
    dealt = _groups(token_pieces(docs, tokenizer_path, max(capacities), end_id, id_column, text_column), total, group_bytes, ["doc_id", "start", "ids", "copy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, chunk, t in _by_group(batches):
            length, ids = t["length"].to_numpy(), t["ids"].to_pylist()
            doc, start = t["doc_id"].to_pylist(), t["start"].to_numpy()
            b, offset, capacity = pack(length, capacities)
            order = np.lexsort((offset, b))
            cuts = np.flatnonzero(np.diff(b[order], prepend=-1)).tolist()
            members = [order[x:y].tolist() for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True)]
            size = np.bincount(b, weights=length).astype(np.int64)
            for x in range(0, len(members), 256):
                some = members[x : x + 256]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_bin_ids(group, chunk, np.arange(x, x + len(some))), pa.int64()),
                        pa.array([int(capacity[m[0]]) for m in some], pa.int64()),
                        pa.array(size[x : x + len(some)], pa.int64()),
                        pa.array([[doc[i] for i in m] for m in some], pa.list_(pa.int64())),
                        pa.array([start[m] for m in some], pa.list_(pa.int64())),
                        pa.array([length[m] for m in some], pa.list_(pa.int64())),
                        pa.array([b"".join([ids[i] for i in m]) for m in some], pa.binary()),
                    ],
                    names=["bin_id", "capacity", "n_tokens", "doc_ids", "starts", "lengths", "ids"],
                )

    kinds = "bin_id long, capacity long, n_tokens long, doc_ids array<long>, starts array<long>, lengths array<long>, ids binary"
    path = path or work_path(spark, "sequences")
    dealt.mapInArrow(run, kinds).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(kinds).parquet(path)


def spans(sequences: DataFrame) -> DataFrame:
    """A row for each piece of written sequences: doc_id, start, length, bin_id, bin_offset, capacity, and ids_crc32 of its ids
    as they are stored."""
    each = sequences.select("bin_id", "capacity", "lengths", "ids", (F.octet_length("ids") / F.col("n_tokens")).cast("int").alias("width"), F.posexplode(F.arrays_zip("doc_ids", "starts", "lengths")).alias("k", "p"))
    at = F.aggregate(F.slice("lengths", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, x: a + x)
    each = each.select("bin_id", "capacity", "ids", "width", at.alias("bin_offset"), F.col("p.doc_ids").alias("doc_id"), F.col("p.starts").alias("start"), F.col("p.lengths").alias("length"))
    own = F.substring("ids", (F.col("bin_offset") * F.col("width") + 1).cast("int"), (F.col("length") * F.col("width")).cast("int"))
    return each.select("doc_id", "start", "length", "bin_id", "bin_offset", "capacity", F.crc32(own).alias("ids_crc32"))
