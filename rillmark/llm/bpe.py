"""BPE encoding and decoding of a word-end vocabulary.

Merging: a segment tree over the adjacent pairs of a word holds each pair's rank, with its place to
break ties. The root is the leftmost pair of the lowest rank. A merge updates at most three leaves
and the nodes above them, until the root says that no pair can be merged. Many words of a batch are
merged at once by numpy, a tree for each row; few or very long words by a tree in a Python list.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillmark.llm.common import ARROW_BATCH_BYTES, Pool, pieces, ragged, small_batches

#: Words whose ids a worker remembers; beyond it the memory is emptied.
REMEMBERED = 700_000
#: Pieces of words, likewise: few, as most are in words that are remembered.
PIECES = 150_000

#: Unicode White_Space, which the vocabulary's normaliser collapses. str.split() would also split at
#: U+001C to U+001F.
_WHITE = re.compile("[\t-\r \x85\xa0  -     　]+")
_UNLIKE = ("\x1c", "\x1d", "\x1e", "\x1f")
#: The vocabulary's own pattern, for words of characters below U+0250; a word holds no white space. There
#: composition changes nothing.
_LETTER, _NUMBER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
_LATIN = re.compile("[\0-\x84\x86-\x9f\xa1-\u012f\u0131-\u024f]*")
_NONE = np.int64(2**62)


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def understood(spec: str) -> dict:
    """The file's contents; ValueError unless it is of the kind that this module reproduces: byte-level words with the suffix
    </w>, lower-cased after composition and the collapse of white space, special tokens that hold <|, and no decoder."""
    file = json.loads(spec)
    model, lacks = file["model"], []
    steps = [x.get("type") for x in ((file.get("normalizer") or {}).get("normalizers") or [])]
    plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>"}
    if model.get("type") != "BPE" or any(model.get(k) != v for k, v in plain.items()) or model.get("byte_fallback") or model.get("ignore_merges"):
        lacks.append("a BPE model of words that end in </w>")
    if steps != ["NFC", "Replace", "Lowercase"]:
        lacks.append("the normalisers NFC, Replace and Lowercase")
    if file.get("decoder") is not None or file.get("post_processor") is not None:
        lacks.append("no decoder and no post-processor")
    if any("<|" not in x["content"] or x.get("normalized") or x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in file["added_tokens"]):
        lacks.append("special tokens with <| that are matched as they are")
    if lacks:
        raise ValueError(f"the tokenizer file needs {'; '.join(lacks)}")
    return file


class WordBpe:
    """Encoder and decoder for a tokenizer file of words with a word-end suffix.

    spec is the JSON text of the file. Special tokens in a text are special, as the file says.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        file = understood(spec)
        model = file["model"]
        vocab: dict[str, int] = model["vocab"]
        self.library = Tokenizer.from_str(spec)
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for text, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = text
        self._specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        end = model["end_of_word_suffix"]
        names = byte_alphabet()
        self._inner = np.array([vocab[c] for c in names], np.int64)
        self._final = np.array([vocab[c + end] for c in names], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        code = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(code, kind="stable")
        self._code, self._rank = code[order], order.astype(np.int64)
        self._made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._by_pair = {int(c): r for r, c in reversed([*enumerate(code.tolist())])}
        self._known: dict[str, bytes] = {}

    # text to words

    def words(self, text: str) -> list[str]:
        if any(c in text for c in _UNLIKE):
            return [x for x in _WHITE.split(text) if x]
        return text.split()

    def _pieces(self, word: str) -> list[str]:
        """What the normaliser and the pattern make of a word, as lower-case strings."""
        if _LATIN.fullmatch(word):
            return _LATIN_PIECE.findall(word.lower())
        plain = self.library.normalizer.normalize_str(unicodedata.normalize("NFC", word))
        alphabet = self._of_shown()
        return [bytes(alphabet[c] for c in x).decode() for x, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    @lru_cache(1)  # noqa: B019  one encoder lives in a worker
    def _of_shown(self) -> dict[str, int]:
        return {c: b for b, c in enumerate(byte_alphabet())}

    # merging

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left << 20 | right
        at = np.minimum(np.searchsorted(self._code, code), len(self._code) - 1)
        return np.where(self._code[at] == code, self._rank[at], -1)

    def merge_one(self, word: bytes) -> list[int]:
        """The ids of one word, by a segment tree in a list."""
        ids = [int(self._inner[b]) for b in word[:-1]] + [int(self._final[word[-1]])]
        n = len(ids)
        if n < 2:
            return ids
        base = 1 << (n - 2).bit_length()
        by_pair, none = self._by_pair, (1 << 60, 0)
        tree = [none] * (2 * base)
        for i in range(n - 1):
            r = by_pair.get(ids[i] << 20 | ids[i + 1])
            if r is not None:
                tree[base + i] = (r, i)
        for i in range(base - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, leaf: tuple[int, int]) -> None:
            i += base
            tree[i] = leaf
            while i > 1:
                i >>= 1
                tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def pair(i: int) -> tuple[int, int]:
            r = by_pair.get(ids[i] << 20 | ids[after[i]]) if after[i] < n else None
            return none if r is None else (r, i)

        while tree[1] is not none and tree[1][0] < none[0]:
            rank, i = tree[1]
            gone = after[i]
            ids[i] = int(self._made[rank])
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            put(gone, none) if gone < n - 1 else None
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
            ids[gone] = -1
        return [x for x in ids if x >= 0]

    def merge_many(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of words of similar length, by one numpy segment tree a row."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, width = len(words), int(lengths.max())
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        data = np.frombuffer(b"".join(words), np.uint8)
        ids = np.full((n, width + 1), -1, np.int64)
        ids[row, col] = np.where(col == lengths[row] - 1, self._final[data], self._inner[data])
        if width > 1:
            depth = max(width - 2, 0).bit_length()
            base = 1 << depth
            place = np.arange(width - 1)
            tree = np.full((n, 2 * base), _NONE, np.int64)
            rank = self._ranks(np.maximum(ids[:, :-2], 0), np.maximum(ids[:, 1:-1], 0))
            tree[:, base : base + width - 1] = np.where((rank >= 0) & (ids[:, 1:-1] >= 0), rank << 20 | place, _NONE)
            for level in range(depth - 1, -1, -1):
                a, b = 1 << level, 2 << level
                tree[:, a:b] = np.minimum(tree[:, b : 2 * b : 2], tree[:, b + 1 : 2 * b : 2])
            after = np.minimum(np.arange(1, width + 2), lengths[:, None])
            before = np.tile(np.arange(-1, width), (n, 1))

            def put(rows: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> None:
                node = at + base
                tree[rows, node] = leaf
                for _ in range(depth):
                    node = node >> 1
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

            def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
                right = ids[rows, after[rows, at]]
                r = self._ranks(ids[rows, at], np.maximum(right, 0))
                return np.where((r >= 0) & (right >= 0), r << 20 | at, _NONE)

            live = np.flatnonzero(tree[:, 1] < _NONE)
            while len(live):
                root = tree[live, 1]
                at = root & ((1 << 20) - 1)
                gone = after[live, at]
                ids[live, at] = self._made[root >> 20]
                ids[live, gone] = -1
                follows = after[live, gone]
                after[live, at] = follows
                before[live, follows] = at
                ids[live, width] = -1
                inner = gone < width - 1
                put(live[inner], gone[inner], np.full(int(inner.sum()), _NONE))
                put(live, at, pair(live, at))
                back = before[live, at]
                has = back >= 0
                put(live[has], back[has], pair(live[has], back[has]))
                live = live[tree[live, 1] < _NONE]
        kept = ids[:, :width] >= 0
        flat = ids[:, :width][kept]
        return np.split(flat, np.cumsum(kept.sum(axis=1))[:-1])

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of words as little-endian unsigned 32-bit integers."""
        parts = {w: [x.encode() for x in self._pieces(w)] for w in words}
        todo = {x for xs in parts.values() for x in xs}
        classes: dict[int, list[bytes]] = {}
        for x in todo:
            classes.setdefault((len(x) - 1).bit_length(), []).append(x)
        made: dict[bytes, bytes] = {}
        for k, group in classes.items():
            if len(group) < 24 or k > 8:
                for x in group:
                    made[x] = np.array(self.merge_one(x), "<u4").tobytes()
                continue
            for a in range(0, len(group), 8192):
                some = group[a : a + 8192]
                for x, ids in zip(some, self.merge_many(some), strict=True):
                    made[x] = ids.astype("<u4").tobytes()
        return {w: b"".join([made[x] for x in xs]) for w, xs in parts.items()}

    # texts

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of whole texts, each as little-endian unsigned 32-bit integers."""
        return cached_encode(texts, self.words, self.encode_words, self._known, self.special, self._specials)

    def decode(self, ids: bytes) -> str:
        """The tokens' strings with a space between: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def cached_encode(
    texts: list[str | None],
    split: Callable[[str], list[str]],
    encode: Callable[[Iterable[str]], dict[str, bytes]],
    known: dict[str, bytes],
    special: dict[str, int],
    specials: re.Pattern | None,
) -> list[bytes]:
    """Encodes texts word by word, each new word of the batch once. Words at a special token's edge stand alone."""
    if len(known) > REMEMBERED:
        known.clear()
    get = known.get
    out: list[list[bytes | None]] = []
    parts: list[list[str]] = []  # the words of each text, or None in place of a special token
    lacking: set[str] = set()
    for text in texts:
        text = text or ""
        if specials is not None and "<|" in text and specials.search(text):
            ws, ids, at = [], [], 0
            for m in specials.finditer(text):
                some = split(text[at : m.start()])
                ws += [*some, ""]
                ids += [*map(get, some), np.array([special[m[0]]], "<u4").tobytes()]
                at = m.end()
            some = split(text[at:])
            ws += some
            ids += map(get, some)
        else:
            ws = split(text)
            ids = [*map(get, ws)]
        if None in ids:
            lacking.update([w for w, x in zip(ws, ids, strict=True) if x is None])
        out.append(ids)
        parts.append(ws)
    if lacking:
        known.update(encode(lacking))
        for ws, ids in zip(parts, out, strict=True):
            if None in ids:
                ids[:] = [known[w] if x is None else x for w, x in zip(ws, ids, strict=True)]
    return [b"".join(ids) for ids in out]


class LibraryEncoder:
    """The same ids from the tokenizers library, each word once: words between special tokens are independent."""

    def __init__(self, spec: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.library = Tokenizer.from_str(spec)
        self.special = {x["content"]: x["id"] for x in understood(spec)["added_tokens"]}
        self._specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self._known: dict[str, bytes] = {}
        # the same model for pieces that are cut and in lower case already
        self._cut = Tokenizer.from_str(spec)
        self._cut.normalizer = normalizers.Sequence([])
        self._cut.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])

        ends = [t for t in self.library.get_vocab(with_added_tokens=False).items() if t[0].endswith("</w>")]
        self._of_piece: dict[str, bytes] = {}
        self._ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
        self._ends[[i for _, i in ends]] = True
        self._forget()

    def _forget(self) -> None:
        # each word's place, and there its number of ids and where they begin in held
        self._place = {"": 0}
        self._count, self._begin, self._held = Pool(np.int32), Pool(np.int64), Pool(np.uint32)
        self._count.add(np.zeros(1))
        self._begin.add(np.zeros(1))

    words = WordBpe.words

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Each word's ids. Latin words are cut into lower-case pieces as the vocabulary does, and each piece is encoded once, many
        as one text that white space separates; all other words go to the library whole, one by one.

        The ids are cut after word-end tokens, of which each piece has one; should a text have another number of them, the words
        of its pieces go one by one as well.
        """
        made: dict[str, bytes] = {}
        whole, mixed, odd = [], [], []
        for w in words:
            if "<|" in w or not (w.isascii() or _LATIN.fullmatch(w)):
                odd.append(w)
            elif w.isalpha():
                whole.append(w)
            else:
                mixed.append(w)
        of = self._of_piece
        lower = [w.lower() for w in whole]
        cut_up = [_LATIN_PIECE.findall(w.lower()) for w in mixed]
        new = [p for p in dict.fromkeys(chain(lower, chain.from_iterable(cut_up))) if p not in of]
        for a in range(0, len(new), 512):
            some = new[a : a + 512]
            ids = np.array(self._cut.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self._ends[ids])
            if len(last) == len(some):
                cut = [0, *(4 * (last + 1)).tolist()]
                data = ids.tobytes()
                of.update(zip(some, [data[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], strict=True))
        if all(map(of.__contains__, new)):
            get = of.__getitem__
            made.update(zip(whole, map(get, lower), strict=True))
            made.update((w, b"".join(map(get, ps))) for w, ps in zip(mixed, cut_up, strict=True))
        else:
            for w, ps in zip(chain(whole, mixed), chain(([p] for p in lower), cut_up), strict=True):
                if None in (found := [*map(of.get, ps)]):
                    odd.append(w)
                else:
                    made[w] = b"".join(found)
        if len(of) > PIECES:
            of.clear()
        for a in range(0, len(odd), 1024):
            some = odd[a : a + 1024]
            for w, e in zip(some, self.library.encode_batch_fast(some, add_special_tokens=False), strict=True):
                made[w] = np.array(e.ids, "<u4").tobytes()
        return made

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return cached_encode(texts, self.words, self.encode_words, self._known, self.special, self._specials)

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """encode_batch() of all texts as one array of numbers, and the n + 1 offsets of the texts. Each distinct word is looked up
        once, in Arrow's dictionary of the batch."""
        if len(self._place) > REMEMBERED:
            self._forget()
        texts = pc.fill_null(texts, "")
        # texts that may hold special tokens, characters that Arrow takes for white space, or very many ids
        alone = pc.or_(pc.match_substring_regex(texts, r"<\||[\x1c-\x1f]"), pc.greater(pc.binary_length(texts), ARROW_BATCH_BYTES))
        lists = pc.utf8_split_whitespace(pc.if_else(alone, "", texts))
        coded = lists.flatten().dictionary_encode()
        some = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self._place.get, some, repeat(-1)), np.int64, len(some))
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            new = [some[i] for i in lacking.tolist()]
            made = self.encode_words(new)
            data = [made[w] for w in new]
            count = np.fromiter(map(len, data), np.int64, len(data)) // 4
            at[lacking] = np.arange(len(self._place), len(self._place) + len(new))
            self._place.update(zip(new, at[lacking].tolist(), strict=True))
            self._begin.add(self._held.n + np.cumsum(count) - count)
            self._count.add(count)
            self._held.add(np.frombuffer(b"".join(data), "<u4"))
        at = at[coded.indices.to_numpy()]
        count = self._count.values[at]
        ids = self._held.values[ragged(self._begin.values[at], count)]
        offsets = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)))
        offsets = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))[offsets]
        odd = np.flatnonzero(alone.to_numpy(zero_copy_only=False))
        if not len(odd):
            return ids, offsets
        every = np.split(ids, offsets[1:-1])
        for i, x in zip(odd.tolist(), self.encode_batch(texts.take(pa.array(odd)).to_pylist()), strict=True):
            every[i] = np.frombuffer(x, "<u4")
        return np.concatenate(every), np.concatenate(([0], np.cumsum([len(x) for x in every])))


_made: dict[tuple[str, str], WordBpe | LibraryEncoder] = {}


def encoder(spec: str, kind: type = WordBpe) -> WordBpe | LibraryEncoder:
    """The worker's encoder for a file; made once in a worker."""
    key = (kind.__name__, hashlib.sha256(spec.encode()).hexdigest())
    if key not in _made:
        _made[key] = kind(spec)
    return _made[key]


def read_spec(path: str, limit: int = 64 << 20) -> str:
    """The tokenizer file's text, which is sent to the workers; a file of more than limit bytes is refused."""
    with open(path, encoding="utf-8") as f:
        text = f.read(limit + 1)
    if len(text) > limit:
        raise ValueError(f"{path} has more than {limit} characters")
    return text


def encode_decode(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", keep: bool = True) -> DataFrame:
    """Encodes every text and decodes its ids again.

    Returns id_column, ids (little-endian unsigned 32-bit integers, binary), decoded (string), n_tokens,
    ids_sha256 and decoded_sha256 (lower-case hex). keep=False leaves ids and decoded out, so that they
    never leave the worker. A null text is an empty one: no ids, empty decoded text. Other columns are
    ignored; a null id is kept; repeated rows give a row each; texts of any length are encoded whole; an empty table gives an
    empty result. A tokenizer file of another kind is refused (see understood).
    """
    small_batches(docs.sparkSession)
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))
    id_type = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        for whole in batches:
            for batch in pieces(whole, "text"):
                every = bpe.encode_batch(batch.column("text").to_pylist())
                texts = [bpe.decode(x) for x in every]
                out = {
                    id_column: batch.column("id"),
                    "n_tokens": pa.array([len(x) // 4 for x in every], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in every], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in texts], pa.string()),
                }
                if keep:
                    out |= {"ids": pa.array(every, pa.binary()), "decoded": pa.array(texts, pa.string())}
                yield pa.RecordBatch.from_pydict(out)

    kinds = f"{id_column} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary, decoded string" if keep else "")
    return docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, kinds)
