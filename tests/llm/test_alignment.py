"""Alignment against a plain version over whole texts, tokenised by the libraries at once."""

import hashlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rillmark.llm import alignment
from rillmark.llm.bpe import byte_alphabet, read_spec
from rillmark.llm.queries import BYTE_BPE, PIECE_BPE, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
A, B = tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE)
ODD = ["", " ", "   ", "a", " a", "a ", "a  b", "a   b  c ", "a \nb", "a\n b", "a\n \nb", "a\n\n b", "\t", "x　 y z", "it's we'll  don't 's", "<|endoftext|> <s> </s> <0x41> <unk>", "x▁y z", "▁", "ﬁ ½ Å é ́x", "日本 語 \U0001f642 ab", "\x00 a", "12 345  6", "word " * 3000, "y" * 5000, "a b\x1c c", "e  f"]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """[(id, end)] by each, or None."""
    a, b = libraries
    if not text:
        return None
    byte = {c: bytes([i]) for i, c in enumerate(byte_alphabet())}
    sides = []
    e = a.encode(" " + text, add_special_tokens=False)
    sides.append([(i, b"".join(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)])
    sides.append([(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)])
    out = []
    for side in sides:
        if b"".join(x for _, x in side) != (" " + text).encode():
            return None
        end, made = 0, []
        for i, x in side:
            end += len(x)
            made.append((i, end))
        out.append(made)
    return out


def plain(libraries, rows):
    per_row, counts = [], Counter()
    for i, text in rows:
        both = tokens(libraries, text)
        if both is None:
            per_row.append((i, 0, 0, [], ""))
            continue
        a, b = both
        cuts = sorted({e for _, e in a} & {e for _, e in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, e in a if low < e <= c) + "|" + ",".join(str(x) for x, e in b if low < e <= c))
            low = c
        end_b = {e: x for x, e in b}
        links = [(x, end_b[e]) for x, e in a if e in end_b]
        counts.update(links)
        per_row.append((i, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(i, na, nb, len(ls), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), sha) for i, na, nb, ls, sha in per_row]


def holds(df, libraries, rows):
    got = [tuple(r) for r in df.collect()]
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(str, got)) == sorted(map(str, plain(libraries, rows)))


def test_words_are_tokenised_apart(libraries):
    """Words of a text, each by itself, give the tokens of the whole text."""
    with open(B, "rb") as f:
        both = alignment.Tokenizers(read_spec(A), f.read())
    for texts in (ODD, [None, "a b", None], [], [None], ["", "x▁ y"], ODD[::-1]):
        (ids_a, ends_a, at_a), (ids_b, ends_b, at_b) = both.tokens(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            want = tokens(libraries, t) or ([], [])
            for (ids, ends, at), side in (((ids_a, ends_a, at_a), want[0]), ((ids_b, ends_b, at_b), want[1])):
                assert list(zip(ids[at[k] : at[k + 1]].tolist(), ends[at[k] : at[k + 1]].tolist())) == side, t


def test_forgetting_changes_nothing(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 3)
    test_words_are_tokenised_apart(libraries)


def test_odd_texts(spark, libraries):
    rows = [(i, t) for i, t in enumerate([*ODD, None])]
    rows += [rows[6], (None, "no id here"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "pairs": F.lit("x"), "links": F.lit(2), "cuts": F.lit(3), "n_a": F.lit(4), "ordered": F.lit(5)})
    holds(alignment.align(df, A, B), libraries, rows)
    holds(alignment.align(df.limit(0), A, B), libraries, [])


def test_query(spark, libraries, docs):
    holds(queries()["op13_token_alignment"](spark, SF), libraries, [(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("most", [0, 40, 400])
def test_without_broadcast_of_all(spark, libraries, docs, monkeypatch, most):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", most)
    few = docs.limit(40).persist()
    holds(alignment.align(few, A, B), libraries, [(r.doc_id, r.text) for r in few.collect()])


def test_groups_and_links(spark):
    made = alignment.grouped(spark.createDataFrame([(1, [5, 6, 7], [2, 5, 9], [8, 9, 8, 3], [3, 5, 8, 9])], "doc_id long, ids_a array<int>, ends_a array<int>, ids_b array<int>, ends_b array<int>")).head()
    assert made.cuts == [5, 9] and made.groups == ["5,6|8,9", "7|8,3"]
    assert [(x >> 32, x & 0x7FFFFFFF) for x in made.links] == [(1, 1), (2, 3)]
    assert [(x >> 32, x & 0x7FFFFFFF) for x in made.pairs] == [(6, 9), (7, 3)]


def test_one_sort_and_no_python_after_tokenising(spark, docs):
    plan = alignment.grouped(alignment.tokenised(docs, A, B)).select("groups", "pairs", "cuts")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(") == 1 and plan.count("MapInArrow") == 1
