"""Near-duplicate documents by b-bit MinHash.

1. One pass over the texts: each document's number of distinct shingles, a digest of its word sequence, and
   HASHES minima of its shingles. Bands of the full minima give bucket keys; of each minimum only BITS
   bits are kept, packed in a signature.
2. Documents of one word sequence are one class; its least id stands for it from here on.
3. Candidates: within each bucket signatures are compared by bit counts, the chance matches of b bits
   being corrected for. What may reach the threshold, by a margin of MARGIN, is joined to a family. A
   bucket gives at most as many edges as it has members, whatever their number of pairs.
4. Confirmation: documents of a family are compared on their full shingle sets, all pairs but those that
   are linked already through others. Confirmed links make the components.

Buckets and families of any size are many tasks of bounded size: see connected().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import flat, marked, mixed, pieces, shingles, small_batches, stored, words
from rillmark.llm.urlfilter import components

SHINGLE, PERCENT = 5, 75
#: 32 bands of 4 minima: a pair of similarity 0.75 shares no bucket with probability 5e-6.
HASHES, ROWS, BITS = 128, 4, 4
#: A pair of similarity 0.75 is estimated lower than 0.75 - MARGIN with probability 4e-6.
MARGIN = 0.18
#: Members of a block of a bucket; documents and shingles of a block of a family.
BUCKET_BLOCK, FAMILY_BLOCK, FAMILY_SHINGLES = 1024, 256, 400_000
#: Members of a large group that meet every block of it, at most.
DELEGATES = 8

_rng = np.random.default_rng(8128)
_A = _rng.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)


def minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HASHES minima of each text's shingle hashes, as rows; texts without any have the largest value."""
    n = len(starts) - 1
    out = np.full((n, HASHES), 0xFFFFFFFF, np.uint32)
    has = np.flatnonzero(np.diff(starts) > 0)
    if len(has):
        x = (values >> np.uint64(32)).astype(np.uint32)
        at = starts[has]
        for k in range(HASHES):
            out[has, k] = np.minimum.reduceat(x * _A[k] + _B[k], at)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's minima, different for each band."""
    wide = low.astype(np.uint64).reshape(len(low), HASHES // ROWS, ROWS)
    key = np.tile(mixed(np.arange(1, HASHES // ROWS + 1, dtype=np.uint64)), (len(low), 1))
    for k in range(ROWS):
        key = mixed(key ^ wide[:, :, k]) + np.uint64(k + 1)
    return key


def packed(low: np.ndarray) -> np.ndarray:
    """BITS bits of each minimum, from all of its bits, packed in 64-bit words."""
    per = 64 // BITS
    few = ((low * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint64).reshape(len(low), HASHES // per, per)
    return np.bitwise_or.reduce(few << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


_ONES = np.uint64(int("0001" * 16, 2))


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated similarity of a signature with each of many: matches by bit counts, less those by chance."""
    x = many ^ one
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    match = 1 - np.bitwise_count(x & _ONES).sum(axis=1, dtype=np.int32) / HASHES
    return (match - 2.0**-BITS) / (1 - 2.0**-BITS)


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, sequence (digest of the words), signature (binary) and bands (keys; empty
    without words)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                data, offsets = flat(batch.column("text"))
                h, starts = words(data, offsets)
                s, at = shingles(h, starts, SHINGLE)
                low = minima(s, at)
                count = [len(np.unique(s[a:b])) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys = band_keys(low).view(np.int64)
                signature = packed(low)
                sequence = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id"),
                        batch.column("text_key"),
                        pa.array(count, pa.int64()),
                        pa.array(sequence, pa.binary()),
                        pa.array([x.tobytes() for x in signature], pa.binary()),
                        pa.array([k if n else [] for k, n in zip(keys, count, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "text_key", "n_shingles", "sequence", "signature", "bands"],
                )

    kinds = "doc_id long, text_key long, n_shingles long, sequence binary, signature binary, bands array<long>"
    return docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text")).mapInArrow(run, kinds)


def in_cells(rows: DataFrame, group: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Deals each row to the cells (group, i, j) with i in i0 to i1 and j in j0 to j1. run gets the rows of a partition, in
    order of cell, and gives edges (a, b)."""
    cells = rows.withColumn("i", F.explode(F.sequence("i0", "i1"))).withColumn("j", F.explode(F.sequence("j0", "j1"))).drop("i0", "i1", "j0", "j1")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(parts, group, "i", "j").sortWithinPartitions(group, "i", "j").mapInArrow(run, "a long, b long").distinct()


def _cells(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.column_stack([batch.column(c).to_numpy() for c in (group, "i", "j")])
        cuts = [0, *(np.flatnonzero((np.diff(cell, axis=0) != 0).any(axis=1)) + 1).tolist(), len(cell)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(cell[a].tolist())
            if held and now != key:
                yield pa.Table.from_batches(held)
                held = []
            key = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


Linked = Callable[[int, np.ndarray], np.ndarray]


def _edges(low: list[np.ndarray], member: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    if low:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(low), pa.int64()), pa.array(np.concatenate(member), pa.int64())], names=["a", "b"])


def spread_links(ids: np.ndarray, linked: Linked) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) that connect what is linked, by search: each member meets those that nothing has reached yet.

    linked(k, others) says which others are linked with member k. Each member has one edge at most, to the least id of
    those it is connected with.
    """
    left = np.ones(len(ids), bool)
    low, member = [], []
    for first in range(len(ids)):
        if not left[first]:
            continue
        left[first] = False
        reached, done = [first], 0
        while done < len(reached):
            k = reached[done]
            done += 1
            others = np.flatnonzero(left)
            if not len(others):
                break
            more = others[linked(k, others)]
            left[more] = False
            reached += more.tolist()
        if len(reached) > 1:
            own = np.unique(ids[reached])
            low.append(np.full(len(own) - 1, own[0]))
            member.append(own[1:])
    yield from _edges(low, member)


def cross_links(part: np.ndarray, side: np.ndarray, linked: Linked) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) between parts of which a member of side 1 is linked with one of side 0; parts that have an edge are one
    from then on."""
    part = part.copy()
    low, member = [], []
    for k in np.flatnonzero(side == 1).tolist():
        others = np.flatnonzero((side == 0) & (part != part[k]))
        if not len(others):
            continue
        found = np.unique(part[others[linked(k, others)]])
        if len(found):
            low.append(np.full(len(found), part[k]))
            member.append(found)
            part[np.isin(part, found)] = part[k]
    yield from _edges(low, member)


def connected(members: Callable[[DataFrame], DataFrame], groups: DataFrame, group: str, load: Callable[[DataFrame], DataFrame], compare: Callable[[pa.Table], Linked]) -> DataFrame:
    """Edges (a, b) that connect all members of each group that are linked, in cells of bounded size.

    groups has the group and blocks, how many cells it takes; members(groups) their doc_id, group, blocks and share (of a
    cell); load(rows) adds what compare(cell) looks at. A group of one block is one cell. Larger ones take two steps:

    1. Each block meets itself and a few delegates of the whole group, so that what is alike is one part; rows grow with members.
    2. Members outside their group's largest part, usually few, meet all members of other parts, block by block. Of two members
       that are linked and not yet in one part one at least is outside the largest, so no link is lost.
    """
    many = groups.where("blocks > 1")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    here = {"i0": own, "i1": own, "j0": F.lit(0), "j1": F.lit(0)}

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, group):
            if cell.num_rows > 1:
                yield from spread_links(cell["doc_id"].to_numpy(), compare(cell))

    if many.isEmpty():
        return in_cells(load(members(groups).withColumns(here)), group, inside)
    large = stored(members(many), "large")
    delegates = large.groupBy(group, F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(DELEGATES)).alias("_d")).agg(F.min("doc_id").alias("doc_id"))
    delegates = delegates.select(group, "doc_id", F.lit(True).alias("_all")).distinct()
    dealt = large.join(delegates, [group, "doc_id"], "left").withColumns(here)
    dealt = dealt.withColumns({"i0": F.when(F.col("_all"), F.lit(0)).otherwise(F.col("i0")), "i1": F.when(F.col("_all"), F.col("blocks") - 1).otherwise(F.col("i1"))}).drop("_all")
    first = stored(in_cells(load(members(groups.where("blocks = 1")).withColumns(here).unionByName(dealt)), group, inside), "links")

    part = components(first).select(F.col("node").alias("doc_id"), F.col("component").alias("part"))
    open_ = large.join(part, "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    parts = stored(open_.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n"), F.sum("share").alias("share")), "parts")
    most = parts.groupBy(group).agg(F.max(F.struct("n", "part")).alias("m"), F.count(F.lit(1)).alias("parts"), F.sum("share").alias("share"))
    # the others' share of cells is the group's without its largest part's
    most = most.where("parts > 1").select(group, F.col("m.part").alias("_most"), F.col("share").alias("_share"))
    rest = parts.join(most, group).where(F.col("part") == F.col("_most")).select(group, "_most", F.greatest(F.lit(1), F.ceil(F.col("_share") - F.col("share"))).cast("int").alias("_outer"))
    rest = stored(rest, "parts")
    if rest.isEmpty():
        return first
    open_ = stored(open_.join(rest, group), "open")
    outer = F.pmod(F.xxhash64("doc_id"), F.col("_outer")).cast("int")
    all_ = open_.withColumns({"side": F.lit(0), "i0": own, "i1": own, "j0": F.lit(0), "j1": F.col("_outer") - 1})
    few = open_.where("part <> _most").withColumns({"side": F.lit(1), "i0": F.lit(0), "i1": F.col("blocks") - 1, "j0": outer, "j1": outer})

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _cells(batches, group):
            side = cell["side"].to_numpy()
            if side.any() and not side.all():
                yield from cross_links(cell["part"].to_numpy(), side, compare(cell))

    # written, so that Spark sees how few these may be
    rows = stored(all_.unionByName(few).drop("_most", "_outer"), "open")
    return first.union(in_cells(load(rows), group, across))


def _signatures(cell: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(cell["signature"].to_pylist()), np.uint64).reshape(cell.num_rows, -1)


def candidate_edges(heads: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Edges (a, b) that connect all documents that share a bucket and may be similar enough.

    heads has doc_id, signature and bands, a row for each class.
    """
    rows = heads.select("doc_id", F.explode("bands").alias("key"))
    # written, as are the other counts that meet their rows again: Spark splits a hot key's rows only where
    # both sides of a join are plain exchanges
    several = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("blocks")), "buckets")
    lowest = PERCENT / 100 - margin

    def compare(cell: pa.Table) -> Linked:
        signature = _signatures(cell)
        return lambda k, o: similarity(signature[k], signature[o]) >= lowest

    def members(groups: DataFrame) -> DataFrame:
        return rows.join(groups, "key").withColumn("share", F.lit(1.0 / BUCKET_BLOCK))

    return connected(members, several, "key", lambda r: r.join(heads.select("doc_id", "signature"), "doc_id"), compare).distinct()


def whole_texts(docs: DataFrame, wanted: DataFrame, repeated: bool, id_column: str, text_column: str) -> Callable[[DataFrame], DataFrame]:
    """A function that adds text to rows of doc_id, text_key and repeated. Rows of one document and text that repeat are made
    one, before they are dealt. wanted has all doc_id that it may be asked for: few other texts are dealt."""
    key = ["doc_id", "text_key"]
    texts = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text_column).alias("text_key"), F.col(text_column).alias("text"))
    texts = marked(texts, wanted).where("_may").drop("_may")

    def load(rows: DataFrame) -> DataFrame:
        if not repeated:
            return texts.join(rows.drop("repeated"), key)
        again = rows.where("repeated").drop("repeated")
        one = texts.join(again.select(key).distinct(), key).groupBy(key).agg(F.first("text").alias("text"))
        return texts.join(rows.where("not repeated").drop("repeated"), key).unionByName(one.join(again, key))

    return load


def confirmed_edges(docs: DataFrame, heads: DataFrame, family: DataFrame, id_column: str = "doc_id", text_column: str = "text", margin: float = MARGIN) -> DataFrame:
    """Edges (a, b) that connect all documents of a family (node, component) that are linked on their full sets."""
    columns = (F.col("doc_id").alias("node"), "text_key", "repeated", "signature", "n_shingles")
    sized = family.join(heads.select(*columns), "node").withColumn("share", F.greatest(F.lit(1.0 / FAMILY_BLOCK), F.col("n_shingles") / F.lit(float(FAMILY_SHINGLES))))
    sized = stored(sized.withColumnsRenamed({"node": "doc_id", "component": "family"}), "families")
    groups = stored(sized.groupBy("family").agg(F.ceil(F.sum("share")).cast("int").alias("blocks")), "families")
    lowest = PERCENT / 100 - margin

    def compare(cell: pa.Table) -> Linked:
        sets = []
        for chunk in cell.select(["text"]).combine_chunks().to_batches():
            for part in pieces(chunk, "text", 1 << 20):
                s, at = shingles(*words(*flat(part.column("text"))), SHINGLE)
                sets += [np.unique(s[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        size = np.array([len(s) for s in sets])
        values, number = np.unique(np.concatenate(sets), return_inverse=True)
        begin = np.cumsum(size) - size
        mark = np.zeros(len(values), np.uint8)
        signature = _signatures(cell)

        def linked(k: int, others: np.ndarray) -> np.ndarray:
            out = np.zeros(len(others), bool)
            if not size[k]:
                return out
            # sizes alone rule out most; then the signature; then the sets decide
            fits = (100 * np.minimum(size[others], size[k]) >= PERCENT * np.maximum(size[others], size[k])) & (size[others] > 0)
            fits &= similarity(signature[k], signature[others]) >= lowest
            at = np.flatnonzero(fits)
            if not len(at):
                return out
            mine = number[begin[k] : begin[k] + size[k]]
            mark[mine] = 1
            o = others[at]
            place = np.concatenate([number[b : b + n] for b, n in zip(begin[o].tolist(), size[o].tolist(), strict=True)])
            both = np.add.reduceat(mark[place], np.cumsum(size[o]) - size[o], dtype=np.int64)
            mark[mine] = 0
            out[at] = 100 * both >= PERCENT * (size[k] + size[o] - both)
            return out

        return linked

    load = whole_texts(docs, sized, not heads.where("repeated").isEmpty(), id_column, text_column)
    return connected(lambda g: sized.drop("n_shingles").join(g, "family"), groups, "family", load, compare).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id and kept.

    Words have A-Z lower-cased and are split at ASCII white space. A document's set is its distinct runs of
    five words; with fewer words the whole sequence; without any (also null text) it is empty and linked with
    nothing. Documents are linked if 100 * intersection >= 75 * union. component_id is the least doc_id that
    links reach; kept says that it is the document's own. Rows of one doc_id are one document, linked with all that any
    of its texts is, and have a row each, with their own n_shingles and one component_id. A null doc_id takes no part:
    component_id null, kept. Texts of any length are compared whole; other columns are ignored; an empty table gives an empty
    result.
    """
    marks = stored(sketches(docs, id_column, text_column), "sketches")
    classes = marks.where("n_shingles > 0 and doc_id is not null").groupBy("sequence").agg(F.min("doc_id").alias("head"))
    classes = stored(classes, "classes")
    member = marks.select("doc_id", "n_shingles", "sequence").join(classes, "sequence", "left")
    first = marks.join(classes, "sequence").where("doc_id = head")
    one = F.min(F.struct("text_key", "n_shingles", "signature", "bands")).alias("_r")
    heads = stored(first.groupBy("doc_id", "sequence").agg(one, F.count(F.lit(1)).alias("_n")).select("doc_id", "_r.*", (F.col("_n") > 1).alias("repeated")), "heads")
    # a document of several texts is in several classes: all of its rows go by one of them, and the classes are one
    ranged = member.where("doc_id is not null").groupBy("doc_id").agg(F.min("head").alias("m"), F.max("head").alias("most"), F.count(F.lit(1)).alias("n"), F.count("head").alias("texts"))
    several = stored(ranged.where("m < most or (texts > 0 and texts < n)").select("doc_id", "m"), "several")
    same = member.join(several, "doc_id").where("head is not null and head <> m").select(F.col("head").alias("a"), F.col("m").alias("b")).distinct()
    edges = confirmed_edges(docs, heads, components(candidate_edges(heads)), id_column, text_column)
    links = components(edges.union(same)).select(F.col("node").alias("head"), "component")
    member = member.join(several, "doc_id", "left").withColumn("head", F.coalesce("m", "head")).drop("m")
    head_of = member.join(links, "head", "left")
    component = F.coalesce("component", "head", "doc_id")
    return head_of.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
