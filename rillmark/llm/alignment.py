"""Alignment of two tokenizers' tokens over the same bytes.

Python only tokenises: a text's token ids by a byte-level BPE (A) and by a sentencepiece model (B), and the byte at which each
token ends, counted from a space put before the text. All else is Spark's higher-order functions over these arrays: the ends
that both have cut the tokens into groups, and the two tokens that end at a cut are a link. Links are counted over the corpus by
id pair, and the counts are joined back.

No token of either kind goes over a single space between two words, so each distinct word is tokenised once in a worker.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.llm.bpe import byte_alphabet, read_spec
from rillmark.llm.common import Pool, pieces, ragged, release, small_batches, stored

#: Bytes of text that are tokenised at once; words, and tokens of theirs, that a worker remembers; words that are tokenised as one text.
PIECE, WORDS, TOKENS, TOGETHER = 1 << 20, 400_000, 4_000_000, 512
#: Id pairs whose counts are broadcast at most (some 40 bytes each).
BROADCAST_PAIRS = 1 << 20

_BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
_INDEX = (1 << 31) - 1


class Tokenizers:
    """Both tokenizers, and what they made of the words seen so far."""

    def __init__(self, spec: str, model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(spec)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        byte = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        vocabulary = self.a.get_vocab()
        if not set(byte) <= set(vocabulary):
            raise ValueError("the first tokenizer isn't a byte-level one")
        bytes_a: list[bytes] = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            bytes_a[i] = b"".join(byte[c] for c in token) if set(token) <= set(byte) else token.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        probe = "ﬁ ½  Å x"
        if any("▁" in p.lstrip("▁") for p in names) or b"".join(bytes_b[i] for i in self.b.encode(probe)) != b" " + probe.encode():
            raise ValueError("the second tokenizer normalises its input, or has pieces that go over spaces")
        # each vocabulary: all bytes, and where each token's begin
        self.vocabularies = [(np.frombuffer(b"".join(v), np.uint8), np.cumsum([0, *map(len, v)]).astype(np.int64)) for v in (bytes_a, bytes_b)]
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.width, self.fine = Pool(np.int32), Pool(bool)
        # of each tokenizer: tokens of a word, where they begin, ids, and ends within the word
        self.made = [(Pool(np.int32), Pool(np.int64), Pool(np.int32), Pool(np.int32)) for _ in self.vocabularies]

    def _add(self, new: list[str]) -> bool:
        """Tokenises new words. Many go as one text, as words are independent; ends tell where the next one begins. False, and
        nothing added, if the bytes of either tokenizer's tokens aren't those of the words."""
        lone = [w for w in new if w != w.strip()]
        if lone:
            alone = set(lone)
            new = [*lone, *(w for w in new if w not in alone)]
        texts = [*lone, *(" ".join(new[a : a + TOGETHER]) for a in range(len(lone), len(new), TOGETHER))]
        raw = np.frombuffer("".join(f" {t}" for t in texts).encode(), np.uint8)
        width = np.array([1 + len(w.encode()) for w in new], np.int64)
        until, found = np.cumsum(width), []
        by_a = [e.ids for e in self.a.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        for (every, begin), per_text in zip(self.vocabularies, (by_a, self.b.encode(texts, num_threads=1)), strict=True):
            ids = np.fromiter(chain.from_iterable(per_text), np.int64)
            size = begin[ids + 1] - begin[ids]
            if not np.array_equal(every[ragged(begin[ids], size)], raw):
                return False
            found.append((ids, np.cumsum(size)))
        for (ids, ends), (counts, starts, held, within) in zip(found, self.made, strict=True):
            last = np.searchsorted(ends, until) + 1
            count = np.diff(last, prepend=0)
            starts.add(held.n + last - count)
            counts.add(count)
            held.add(ids)
            within.add(ends - np.repeat(until - width, count))
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.width.add(width)
        self.fine.add(np.ones(len(new), bool))
        return True

    def _learn(self, new: list[str]) -> None:
        # U+2581 stands for a space in pieces: it is never given back
        plain = [w for w in new if "▁" not in w]
        if plain and not self._add(plain):
            for w in plain:
                self._add([w])
        lost = [w for w in new if w not in self.place]
        self.place.update(zip(lost, range(len(self.place), len(self.place) + len(lost)), strict=True))
        self.width.add(np.zeros(len(lost)))
        self.fine.add(np.zeros(len(lost), bool))
        for counts, starts, _, _ in self.made:
            counts.add(np.zeros(len(lost)))
            starts.add(np.zeros(len(lost)))

    def _places(self, some: list[str], skip: np.ndarray | None = None) -> np.ndarray:
        """Where the words are, after learning those that are new; -1 for those to skip."""
        at = np.fromiter(map(self.place.get, some, repeat(-1)), np.int64, len(some))
        lacking = np.flatnonzero(at < 0 if skip is None else (at < 0) & ~skip)
        if len(lacking):
            self._learn(list(dict.fromkeys(some[i] for i in lacking.tolist())))
            at[lacking] = [self.place[some[i]] for i in lacking.tolist()]
        return at

    def _of_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The words of all texts as places, and n + 1 offsets."""
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        coded = lists.flatten().dictionary_encode()
        some = coded.dictionary.to_pylist()
        # a space beside other white space doesn't end a word
        loose = pc.or_(pc.equal(coded.dictionary, ""), pc.not_equal(pc.utf8_trim_whitespace(coded.dictionary), coded.dictionary)).to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
        which = coded.indices.to_numpy()
        odd = np.flatnonzero(np.bincount(np.searchsorted(offsets, np.flatnonzero(loose[which]), "right") - 1, minlength=len(texts)))
        at = self._places(some, loose)[which]
        if not len(odd):
            return at, offsets
        again = [_BETWEEN_WORDS.split(t) if (t := texts[i].as_py()) else [] for i in odd.tolist()]
        cut = np.split(at, offsets[1:-1])
        redone = np.split(self._places(list(chain.from_iterable(again))), np.cumsum([len(w) for w in again])[:-1])
        for i, places in zip(odd.tolist(), redone, strict=True):
            cut[i] = places
        return np.concatenate(cut), np.concatenate(([0], np.cumsum([len(c) for c in cut]))).astype(np.int64)

    def tokens(self, texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For A and B: ids and ends of all texts, and n + 1 offsets. A null or empty text, and one whose bytes a tokenizer
        doesn't give back, has no tokens."""
        if len(self.place) > WORDS or max(held.n for _, _, held, _ in self.made) > TOKENS:
            self.forget()
        at, offsets = self._of_texts(texts)
        per_text = np.diff(offsets)
        lost = ~self.fine.values[at]
        if lost.any():
            bad = np.zeros(len(per_text), bool)
            bad[np.repeat(np.arange(len(per_text)), per_text)[lost]] = True
            at, per_text = at[np.repeat(~bad, per_text)], np.where(bad, 0, per_text)
        first = np.concatenate(([0], np.cumsum(per_text)))
        begin = np.concatenate(([0], np.cumsum(self.width.values[at], dtype=np.int64)))
        begin = (begin[:-1] - np.repeat(begin[first[:-1]], per_text)).astype(np.int32)
        out = []
        for counts, starts, held, within in self.made:
            n = counts.values[at]
            took = ragged(starts.values[at], n)
            out.append((held.values[took], within.values[took] + np.repeat(begin, n), np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[first]))
        return out


_held: dict[int, Tokenizers] = {}


def _tokenizers(spec: str, model: bytes) -> Tokenizers:
    """A worker's own, made once."""
    key = hash((spec, model))
    if key not in _held:
        _held.clear()
        _held[key] = Tokenizers(spec, model)
    return _held[key]


def tokenised(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, ids_a, ends_a, ids_b, ends_b: the tokens of each text. The two files are read on the driver."""
    small_batches(docs.sparkSession)
    with open(path_b, "rb") as f:
        files = docs.sparkSession.sparkContext.broadcast((read_spec(path_a), f.read()))
    numbers = T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField("doc_id", T.LongType())] + [T.StructField(n, numbers, False) for n in ("ids_a", "ends_a", "ids_b", "ends_b")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _tokenizers(*files.value)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                columns = [part.column("doc_id")]
                for ids, ends, offsets in both.tokens(part.column("text")):
                    columns += [pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(x)) for x in (ids, ends)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            release()

    work = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    return work.mapInArrow(run, schema)


def grouped(tokens: DataFrame) -> DataFrame:
    """Adds to tokenised() rows: cuts (byte ends that both have), links (for each cut the places, from 0, of A's and B's token that
    end there, as place_a << 32 | place_b), pairs (their ids, likewise), groups (`a1,a2|b1`, a string for each cut).

    Linear but for one sort of both ends, A's with their places below, B's with a mark that is greater than any place. In that
    order an A token that ends at a cut is less than 2**31 before the next number, all others are more; and as many of B's tokens
    come before it as its place there less its own.
    """
    low = lambda x: x.bitwiseAND(F.lit(_INDEX).cast("long"))
    none = F.lit(-1).cast("long")
    coded_a = F.transform("ends_a", lambda e, i: F.shiftleft(e.cast("long"), 32) + i)
    coded_b = F.transform("ends_b", lambda e: F.shiftleft(e.cast("long"), 32) + _INDEX)
    at_cut = lambda x, j: F.when(F.get("ordered", j + 1) - x < 1 << 31, F.shiftleft(low(x), 32) + (j - low(x))).otherwise(none)
    out = tokens.withColumn("cuts", F.array_intersect("ends_a", "ends_b")).withColumn("ordered", F.sort_array(F.concat(coded_a, coded_b)))
    out = out.withColumn("links", F.array_remove(F.transform("ordered", at_cut), none)).drop("ordered")
    out = out.withColumns({"last_a": F.transform("links", lambda x: F.shiftright(x, 32).cast("int")), "last_b": F.transform("links", lambda x: low(x).cast("int"))})

    # a group ends at its link's places and begins after those of the link before
    out = out.withColumns({f"before_{side}": F.concat(F.array(F.lit(-1)), f"last_{side}") for side in "ab"})

    def joined(ids: str, before: Column, last: Column) -> Column:
        # most groups have a token or two of a side, for which no array need be made
        shown = lambda at: F.get(ids, at).cast("string")
        many = F.array_join(F.slice(ids, before + 2, last - before).cast("array<string>"), ",")
        return F.when(last - before == 1, shown(last)).when(last - before == 2, F.concat(shown(last - 1), F.lit(","), shown(last))).otherwise(many)

    groups = F.transform("last_a", lambda x, k: F.concat(joined("ids_a", F.get("before_a", k), x), F.lit("|"), joined("ids_b", F.get("before_b", k), F.get("last_b", k))))
    pairs = F.zip_with("last_a", "last_b", lambda a, b: F.shiftleft(F.get("ids_a", a).cast("long"), 32) + F.get("ids_b", b))
    return out.withColumns({"groups": groups, "pairs": pairs}).drop("last_a", "last_b", "before_a", "before_b")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """For each id pair in the `pairs` arrays: pair, count (links that have it, over all rows), best (whether no other pair of its
    B id has more)."""
    counts = pairs.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(_INDEX).cast("long"))))
    return counts.withColumn("best", F.col("count") == most)


def scored(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """For each key of (key, pairs): n_best and count_sum over its links. Counts of the most frequent pairs, BROADCAST_PAIRS at
    most, are broadcast; links of other pairs, none of which is frequent, are joined by a shuffle."""
    links = pairs.select("key", F.explode("pairs").alias("pair"))
    add = [F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum")]
    distinct = counts.count()
    if distinct <= BROADCAST_PAIRS:
        return links.join(F.broadcast(counts), "pair").groupBy("key").agg(*add)
    bound = counts.agg(F.percentile_approx("count", 1 - BROADCAST_PAIRS / distinct, 10_000)).head()[0]
    frequent, rare = counts.where(F.col("count") > bound), counts.where(F.col("count") <= bound)
    if frequent.count() > 2 * BROADCAST_PAIRS:  # the percentile is approximate
        return links.join(counts, "pair").groupBy("key").agg(*add)
    found = links.join(F.broadcast(frequent), "pair").select("key", "best", "count")
    others = links.join(F.broadcast(frequent.select("pair")), "pair", "left_anti").join(rare, "pair").select("key", "best", "count")
    return found.unionByName(others).groupBy("key").agg(*add)


def align(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """How two tokenizers' tokens of each text fit together, a row for each row.

    doc_id; n_a, n_b: tokens; n_groups: groups between the bytes where tokens of both end; n_links: pairs of tokens that end
    together; n_best: links whose id pair is among the most frequent of its B id; count_sum: links of the corpus that have the same
    id pair, summed over links; groups_sha256: of `a1,a2|b1;a3|b2,b3`.

    Texts that are null or empty, or that a tokenizer doesn't give back byte by byte (with B those that hold U+2581), have no
    tokens: zeros and an empty digest. Null ids, ties and repeated rows are rows like others; an empty table gives an empty
    result; other columns are ignored. A text's arrays take some ten times its bytes, and an array has 2 GB at most.
    """
    made = grouped(tokenised(docs, path_a, path_b, id_column, text_column))
    digest = F.when(F.size("links") > 0, F.sha2(F.array_join("groups", ";"), 256)).otherwise("")
    rows = made.select(F.monotonically_increasing_id().alias("key"), "doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("ids_a", "n_a"), ("ids_b", "n_b"), ("cuts", "n_groups"), ("links", "n_links"))], digest.alias("groups_sha256"), "pairs")
    rows = stored(rows, "aligned")
    counts = stored(pair_counts(rows.select("pairs")), "pair_counts")
    sums = scored(rows.select("key", "pairs"), counts)
    out = rows.drop("pairs").join(sums, "key", "left").drop("key")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
