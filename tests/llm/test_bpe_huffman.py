import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rillmark.llm import huffman
from rillmark.llm.bpe import LibraryEncoder, WordBpe, encode_decode, read_spec
from rillmark.llm.queries import op1_bpe_roundtrip, tokenizer_path

from .conftest import ODD, SF

SPEC = read_spec(tokenizer_path())
OWN, LIBRARY, WORDS = WordBpe(SPEC), Tokenizer.from_str(SPEC), LibraryEncoder(SPEC)


def reference(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    want = reference(text)
    assert OWN.encode_batch([text]) == [want]
    assert WORDS.encode_batch([text]) == [want]
    assert OWN.decode(want) == LIBRARY.decode(np.frombuffer(want, "<u4").tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("text", [*ODD[:8], "ab<|endoftext|>cd <|startoftext|><|endoftext|>", "it's WE'LL 12 \x1c\x85 x", "</w> <|en"])
def test_special_and_odd(text):
    assert OWN.encode_batch([text]) == WORDS.encode_batch([text]) == [reference(text)]


def test_other_files_are_refused():
    import json

    for change in ({"decoder": {"type": "BPEDecoder"}}, {"normalizer": None}, {"added_tokens": [{"id": 1, "content": "[X]"}]}, {"model": {"type": "WordPiece"}}):
        with pytest.raises(ValueError, match="tokenizer file needs"):
            WordBpe(json.dumps(json.loads(SPEC) | change))


def test_both_trees_agree():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeth ing").strip() or "e" for _ in range(r.randrange(1, 70))).encode() for _ in range(300)]
    many = OWN.merge_many(words)
    for w, ids in zip(words, many, strict=True):
        assert ids.tolist() == OWN.merge_one(w)
        assert ids.astype("<u4").tobytes() == reference(w.decode())
    long = "".join(r.choice("abcdefgh") for _ in range(4000))
    assert np.array(OWN.merge_one(long.encode()), "<u4").tobytes() == reference(long)


def test_query_on_tables(spark, docs, odd, none):
    got = {r.doc_id: r for r in op1_bpe_roundtrip(spark, SF).collect()}
    assert len(got) == docs.count()
    rows = encode_decode(odd, tokenizer_path()).collect()
    assert sorted(bytes(r.ids) for r in rows) == sorted(reference(r.text) for r in odd.collect())
    assert all(r.n_tokens * 4 == len(r.ids) for r in rows)
    assert encode_decode(none, tokenizer_path()).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=1, max_size=60), st.integers(6, 16))
def test_code_lengths(counts, longest):
    counts = np.array(counts)
    lengths = huffman.code_lengths(counts, longest)
    used = counts > 0
    assert ((lengths > 0) == used).all()
    assert lengths.max() <= longest
    if used.sum() > 1:
        assert sum(2.0 ** -float(x) for x in lengths[used]) == 1.0
    # as cheap as Huffman's own code where the limit doesn't bind
    import heapq

    heap = [(int(c), 0) for c in counts[used]]
    heapq.heapify(heap)
    cost, depth = 0, 0
    while len(heap) > 1:
        (a, da), (b, db) = heapq.heappop(heap), heapq.heappop(heap)
        cost, depth = cost + a + b, max(da, db) + 1
        heapq.heappush(heap, (a + b, max(da, db) + 1))
    if depth <= longest and used.sum() > 1:
        assert int((counts * lengths).sum()) == cost


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 400), max_size=12), st.integers(0, 9))
def test_coded_texts(counts, seed):
    counts = np.array(counts, np.int64)
    ids = np.minimum(np.random.default_rng(seed).geometric(0.01, counts.sum()), 3000)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=3001))
    made = huffman.encode_texts(ids, counts, lengths, huffman.canonical(lengths))
    base, marks = 0, [np.zeros(0, np.int64)]
    for bits, mark in made:
        marks.append(np.frombuffer(mark, "<u4").astype(np.int64) + base)
        base += 8 * len(bits)
    got = huffman.decode_texts(b"".join(b for b, _ in made), np.concatenate(marks), counts, huffman.decode_table(lengths))
    assert got.tolist() == ids.tolist()


def test_files(spark, docs, odd, none):
    got = sorted(huffman.roundtrip(docs, tokenizer_path()).collect(), key=lambda r: r.doc_id)
    start = 0
    for r, d in zip(got, docs.orderBy("doc_id").collect(), strict=True):
        want = reference(d.text) + np.array([1], "<u4").tobytes()
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want) // 4, zlib.crc32(want))
        start += r.n_tokens
    assert huffman.roundtrip(none, tokenizer_path()).count() == 0
    rows = huffman.roundtrip(odd, tokenizer_path()).collect()
    assert len(rows) == odd.count()
    assert sum(r.n_tokens for r in rows) == sum(len(reference(r.text)) // 4 + 1 for r in odd.collect())


def test_small_blocks(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 50)
    monkeypatch.setattr(huffman, "BLOCK_BYTES", 300)
    monkeypatch.setattr(huffman, "BUCKET_WORDS", 10)
    text = lambda i: "word the Of <|endoftext|> <|ENDOFTEXT|> a<|endoftext|>b a\xa0b " * i
    df = spark.createDataFrame([(i * 7 % 13, text(i * 7 % 13)) for i in range(13)], "doc_id long, text string").repartition(5)
    path = huffman.write_corpus(df, tokenizer_path(), f"file://{tmp_path}/set")
    # another session knows nothing but the path
    other = spark.newSession()
    assert other.read.parquet(f"{path}/blocks").count() > 5
    rows = sorted(huffman.decode(other, path).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(13))
    assert [(r.part, r.block, r.before) for r in rows] == sorted((r.part, r.block, r.before) for r in rows)
    for r in rows:
        assert bytes(r.ids) == reference(text(r.doc_id)) + np.array([1], "<u4").tobytes()
    monkeypatch.setattr(huffman, "VERSION", 2)
    with pytest.raises(ValueError, match="version 1"):
        huffman.decode(other, path)


def test_files_are_in_order_of_id(spark, tmp_path):
    """Over the files' names as well; an id with a third of all rows, and null ids, are shared among parts."""
    import glob

    import pyarrow.parquet as pq

    rows = [(7000 if i % 3 == 0 else (None if i % 5 == 0 else i * 7919 % 20011), f"words of text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    path = f"{tmp_path}/set"
    huffman.write_corpus(df, tokenizer_path(), f"file://{path}")
    ids, where = [], {}
    for name in sorted(glob.glob(f"{path}/blocks/part-*")):
        own = sorted(pq.read_table(name).to_pylist(), key=lambda b: (b["part"], b["block"]))
        for b in own:
            found = np.frombuffer(b["doc_ids"], "<i8").tolist()
            ids += found
            for i in set(found):
                where.setdefault(i, set()).add(name)
    assert ids == sorted(ids) and len(ids) == 3000
    assert len(where[7000]) > 2 and len(where[-(2**63)]) > 1
    got = sorted(huffman.roundtrip(df, tokenizer_path()).collect(), key=lambda r: r.start)
    assert np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist() == [r.start for r in got]
    order = [-(2**63) if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)


def test_flat_ids_of_batches():
    """encode_flat() gives the library's ids, whatever stands between words, over batches that share words."""
    space = "".join(f"a{chr(c)}b" for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    some = [space[k : k + 90] for k in range(0, len(space), 90)]
    texts = [None, "", " ", "\x1c", "a\x1fb  c", *ODD, *some, "one<|two|> three", *(f"x {s} y" for s in WORDS.special), " lead", "trail ", "Word word WORD don't", " end "]
    for a in (0, 7, 0):
        got, offsets = WORDS.encode_flat(pa.array(texts[a:], pa.string()))
        assert len(offsets) == len(texts[a:]) + 1
        for t, x, y in zip(texts[a:], offsets[:-1], offsets[1:], strict=True):
            assert got[x:y].tolist() == LIBRARY.encode(t or "", add_special_tokens=False).ids, t
    assert WORDS.encode_flat(pa.array([], pa.string()))[1].tolist() == [0]


def test_pieces_are_remembered_within_bounds(monkeypatch):
    """Pieces that words before had aren't encoded again, and a worker keeps no more than a number of them."""
    from rillmark.llm import bpe as module

    library = module.LibraryEncoder(module.read_spec(tokenizer_path()))
    want = library.encode_words(["Stone,", "STONE", "wall"])
    with monkeypatch.context() as m:
        m.setattr(library, "_cut", None)  # nothing is left to encode
        assert library.encode_words(["stone", "Wall,", "stone,"]) == {"stone": want["STONE"], "Wall,": want["wall"] + want["Stone,"][len(want["STONE"]) :], "stone,": want["Stone,"]}
    monkeypatch.setattr(module, "PIECES", 2)
    assert library.encode_words(["stone", "wall"]) == {"stone": want["STONE"], "wall": want["wall"]} and not library._of_piece
