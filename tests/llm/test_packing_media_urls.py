import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillmark.llm import packing, telephony, urlfilter
from rillmark.llm.queries import op2_best_fit_packing, op3_url_filter, op5_telephony_media, tokenizer_path

from .conftest import ODD, SF


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_pack(lengths):
    lengths = np.array(lengths, np.int64)
    b, offset, capacity = packing.pack(lengths, (16, 32, 64), 2)
    for k in set(b.tolist()):
        own = b == k
        assert (capacity[own] == capacity[own][0]).all()
        total = int(lengths[own].sum())
        # shrunk to the least size that holds it, and nothing lies on anything else
        assert capacity[own][0] == min(c for c in (16, 32, 64) if c >= total)
        ends = sorted(zip(offset[own].tolist(), lengths[own].tolist(), strict=True))
        assert [o for o, _ in ends] == [0, *np.cumsum([n for _, n in ends])[:-1].tolist()]


def cheapest(lengths, sizes, overhead):
    """The least cost of any packing, over all ways to share pieces among bins."""
    best = [math.inf]

    def go(i, bins):
        if i == len(lengths):
            best[0] = min(best[0], sum(min(c for c in sizes if c >= b) + overhead for b in bins))
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= max(sizes):
                go(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=7))
def test_pack_against_the_optimum(lengths):
    """Never beyond 3/2 of the optimum on small inputs."""
    b, _, capacity = packing.pack(np.array(lengths, np.int64), (16, 32, 64), 2)
    cost = sum(int(capacity[b == k][0]) + 2 for k in set(b.tolist()))
    assert cost <= 1.5 * cheapest(lengths, (16, 32, 64), 2)


def fill(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.length, r.capacity))
    for held in bins.values():
        held.sort()
        assert [o for o, _, _ in held] == [0, *np.cumsum([n for _, n, _ in held])[:-1].tolist()]
        assert sum(n for _, n, _ in held) <= held[0][2]
    return sum(r.length for r in rows) / sum(v[0][2] for v in bins.values())


def test_repeated_rows_are_dealt_to_all_groups(spark, docs):
    """A third and more of rows may be equal: no group holds them all, none is lost, and splits make no difference."""
    row = docs.where("length(text) > 200").select("doc_id", "text").limit(1)
    many = row.crossJoin(spark.range(2000)).drop("id").union(docs.select("doc_id", "text").limit(50))
    made = [packing.pack_sequences(df, tokenizer_path(), (512, 1024), group_bytes=40_000) for df in (many, many.repartition(5, F.rand(3)))]
    one, other = (sorted(map(str, packing.spans(m).collect())) for m in made)
    assert one == other
    key = row.head()[0]
    assert packing.spans(made[0]).where(F.col("doc_id") == key).where("start = 0").count() >= 2000
    held = [r[1] for r in made[0].groupBy(F.shiftright("bin_id", 35).alias("g")).agg(F.sum("n_tokens")).collect()]
    assert len(held) > 5 and max(held) < 3 * sum(held) / len(held)
    by_length = packing.best_fit(many, F.lit(300), (512, 1024), 40_000)
    assert by_length.count() == many.count()
    held = [r[1] for r in by_length.groupBy(F.shiftright("bin_id", 35).alias("g")).agg(F.sum("length")).collect()]
    assert len(held) > 5 and max(held) < 3 * sum(held) / len(held)


def test_bin_ids():
    """Groups, chunks and bins have ids of their own, up to the largest; beyond, an error instead of equal ids."""
    at = [(0, 256, 0), (1, 0, 0), (0, 0, 2**18 - 1), (0, 1, 0), (0, 2**17 - 1, 0), (2**28 - 1, 2**17 - 1, 2**18 - 1)]
    ids = [int(packing._bin_ids(g, c, np.array([b]))[0]) for g, c, b in at]
    assert len(set(ids)) == len(ids) and min(ids) >= 0 and max(ids) == 2**63 - 1
    for g, c, b in [(2**28, 0, 0), (0, 2**17, 0), (0, 0, 2**18)]:
        with pytest.raises(ValueError):
            packing._bin_ids(g, c, np.array([b]))


def test_packing_by_length(spark, docs, odd, none):
    tokens = F.coalesce(F.size(F.split("text", " ")), F.lit(0)) + 1
    for df in (docs, odd):
        rows = packing.best_fit(df, tokens, (64, 256, 1024), 5000).collect()
        want = df.select("doc_id", tokens.alias("n")).collect()
        assert sum(r.length for r in rows) == sum(r.n for r in want)
        assert {r.doc_id for r in rows} == {r.doc_id for r in want}
        assert fill(rows) > 0.8
    assert packing.best_fit(none, F.lit(3)).count() == 0
    null = packing.best_fit(odd, F.lit(None)).collect()
    assert len(null) == odd.count()
    assert all(r.length == 0 and r.bin_id is None for r in null)


def test_a_long_document_is_many_groups(spark):
    df = spark.createDataFrame([(1, 3_000_000), (2, 5)], "doc_id long, n long")
    dealt = packing.best_fit(df, F.col("n"))
    groups = dealt.where("bin_id is not null").select((F.col("bin_id") / (1 << 28)).cast("long").alias("g")).groupBy("g").count().collect()
    assert len(groups) > 8
    assert max(r["count"] for r in groups) * 4096 < 4 * packing.GROUP_TOKENS


def test_sequences_hold_all_ids(spark, docs, odd, none):
    library = Tokenizer.from_file(tokenizer_path())
    for df in (docs, odd.withColumns({"starts": F.lit(1), "lengths": F.lit(2), "g": F.lit(3)})):
        sequences = packing.pack_sequences(df, tokenizer_path(), (64, 256, 1024), group_bytes=40_000)
        found = collections.defaultdict(list)
        for r in sequences.collect():
            ids = np.frombuffer(r.ids, "<u2")
            assert len(ids) == r.n_tokens == sum(r.lengths) and r.capacity == min(c for c in (64, 256, 1024) if c >= r.n_tokens)
            at = 0
            for i, start, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
                found[i, start].append(tuple(ids[at : at + n].tolist()))
                at += n
        want = collections.defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            ids = [*library.encode(r.text or "", add_special_tokens=False).ids, packing.END_ID]
            for a in range(0, len(ids), 1024):
                want[r.doc_id, a].append(tuple(ids[a : a + 1024]))
        assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
        rows = packing.spans(sequences).collect()
        assert fill(rows) > 0.9
        for r in rows:
            crc = {zlib.crc32(np.array(x, "<u2").tobytes()) for x in want[r.doc_id, r.start]}
            assert r.ids_crc32 in crc
    assert packing.pack_sequences(none, tokenizer_path()).count() == 0


def test_sequences_do_not_depend_on_the_split(spark, docs):
    one = packing.spans(packing.pack_sequences(docs, tokenizer_path())).collect()
    other = packing.spans(packing.pack_sequences(docs.repartition(7, "n_chars"), tokenizer_path())).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, other))
    assert sorted(map(tuple, op2_best_fit_packing(spark, SF).collect())) == sorted(map(tuple, one))


def test_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    # fixed points of the two laws
    assert (mu[0], mu[0x7F], mu[0x80], mu[0xFF]) == (-32124, 0, 32124, 0)
    assert (a[0x55], a[0xD5], a[0x2A], a[0xAA]) == (-8, 8, -32256, 32256)
    assert (np.sort(a[128:]) > 0).all()


def test_adpcm_blocks():
    r = np.random.default_rng(1)
    data = r.integers(0, 256, 36 * 5 + 10, dtype=np.uint8)
    data[2::36] %= 89
    got = telephony.decode_ima(data.tobytes(), 36)
    # one block after another, one sample after another
    want = []
    for at in range(0, len(data), 36):
        b = data[at : at + 36]
        if len(b) < 4:
            break
        value, index = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), min(int(b[2]), 88)
        want.append(value)
        for byte in b[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(telephony.IMA_STEP[index])
                d = step >> 3
                d += (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
                value = max(-32768, min(32767, value - d if code & 8 else value + d))
                index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                want.append(value)
    assert got.tolist() == want
    assert len(telephony.decode_ima(b"", 36)) == 0


@pytest.mark.parametrize(("rate", "to"), [(8000, 16000), (16000, 8000), (8000, 11025), (8000, 8000)])
def test_resample_keeps_a_tone(rate, to):
    t = np.arange(4000) / rate
    got = telephony.resample((8000 * np.sin(2 * np.pi * 400 * t)).astype(np.int16), rate, to)
    assert len(got) == -(-4000 * to // rate)
    want = 8000 * np.sin(2 * np.pi * 400 * np.arange(len(got)) / to)
    assert np.abs(got - want)[50:-50].max() < 160


def test_media_column(spark, odd, none):
    block = bytes([0, 0, 5, 0]) + bytes(range(32))
    files = [telephony.wav(b"\x00\xff\x80", telephony.MULAW), telephony.wav(b"\x55\xd5", telephony.ALAW), telephony.wav(block, telephony.IMA, 8000, 36), telephony.wav(b"", telephony.PCM), b"junk", None]
    df = spark.createDataFrame(list(enumerate(files)), "id long, media binary").withColumn("feature", F.lit("clash"))
    rows = {r.id: r for r in telephony.decode_column(df, "id", to=8000).collect()}
    assert np.frombuffer(rows[0].pcm, "<i2").tolist() == [-32124, 0, 32124]
    assert rows[2].n_samples == 65
    assert rows[3].n_samples == 0
    assert rows[4].pcm is None
    assert rows[5].error == "not a RIFF WAVE file"
    stored = telephony.describe_bytes(telephony.store_bytes(odd)).collect()
    assert len(stored) == odd.count()
    by_id = {r.doc_id: r for r in stored}
    for i, text in enumerate(ODD):
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = by_id[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_bytes > len(payload)
    assert by_id[6].feature == by_id[7].feature
    assert by_id[6].media_sha256 == by_id[7].media_sha256
    assert telephony.describe_bytes(telephony.store_bytes(none)).count() == 0


def plain_samples(payload, codec):
    """Samples by the standards' formulas, one after another."""
    out = []
    if codec == "ima":
        for a in range(0, len(payload), 64):
            value, index = 0, 16
            out.append(value)
            for byte in payload[a : a + 64]:
                for code in (byte & 15, byte >> 4):
                    step = int(telephony.IMA_STEP[index])
                    d = sum(step >> shift for shift, bit in ((0, 4), (1, 2), (2, 1)) if code & bit) + (step >> 3)
                    value = max(-32768, min(32767, value - d if code & 8 else value + d))
                    index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[code & 7]))
                    out.append(value)
        return out
    for byte in payload:
        if codec == "mulaw":
            u = byte ^ 0xFF
            size = (((u & 15) * 2 + 33) << (u >> 4 & 7)) - 33
            out.append((-size if u & 128 else size) * 4)
        else:
            u = byte ^ 0x55
            size = (u & 15) * 2 + 1 if not u >> 4 & 7 else ((u & 15) * 2 + 33) << ((u >> 4 & 7) - 1)
            out.append((size if u & 128 else -size) * 8)
    return out


def halved(x):
    """Every second output of a windowed sinc of half the band, from the definition."""
    h = [0.5 * np.sinc(0.5 * k) * (0.5 + 0.5 * math.cos(2 * math.pi * k / 16)) for k in range(-7, 9)]
    h = np.array(h) / sum(h)
    padded = np.concatenate((np.zeros(7), x, np.zeros(9)))
    return [float(padded[2 * i : 2 * i + 16] @ h) for i in range(-(-len(x) // 2))]


def test_media_query(spark, docs):
    """Every document's stored sound against formulas: digests, codec and resampled PCM."""
    rows = {r.doc_id: r for r in op5_telephony_media(spark, SF).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert set(rows) == set(texts)
    assert {r.codec for r in rows.values()} == {"mulaw", "alaw", "ima"}
    for i, raw in texts.items():
        r, payload = rows[i], raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.codec == ("mulaw", "alaw", "ima")[zlib.crc32(payload) % 3]
        if len(payload) > 6000:
            continue
        pcm = np.frombuffer(r.pcm, "<i2").astype(int)
        want = np.clip(halved(plain_samples(payload, r.codec)), -32768, 32767)
        assert len(pcm) == len(want) and np.abs(pcm - want).max() <= 1
        n, rms, peak, turns, crc = (x.split("=")[1] for x in r.feature.split(";"))
        assert (int(n), int(peak), crc) == (len(pcm), np.abs(pcm).max(), f"{zlib.crc32(r.pcm):08x}")
        assert int(rms) == int(math.sqrt(int((pcm**2).sum()) // len(pcm))) and int(turns) == np.count_nonzero((pcm[1:] >= 0) != (pcm[:-1] >= 0))


def test_long_sounds_in_chunks(monkeypatch):
    x = np.random.default_rng(2).integers(-32768, 32767, 5000).astype(np.int16)
    want = [(telephony.resample(x, 8000, to), telephony.feature(x)) for to in (4000, 11025)]
    monkeypatch.setattr(telephony, "CHUNK", 64)
    for (y, f), to in zip(want, (4000, 11025), strict=True):
        assert telephony.resample(x, 8000, to).tolist() == y.tolist()
        assert telephony.feature(x) == f


URLS = [
    ("https://WWW.Example.com/en/x?y#z", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
    ("http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("http://a.b.example.com/en/1", "a.b.example.com", "/en/1", "example.com/en/", "block"),
    ("http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/es", "x.net", "/es", None, "allow"),
    ("http://com", "com", "", None, "allow"),
    ("ftp://É.COM/a", "É.com", "/a", "com/", "allow"),
    ("nothing", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://?q=http://x.com/", "", "", None, "allow"),
]


def test_rules(spark):
    df = spark.createDataFrame([(i, u, None) for i, (u, *_) in enumerate(URLS)], "page_id long, url string, html string").withColumns({"rule": F.lit(1), "node": F.lit(2)})
    many = [*urlfilter.RULES, *[(f"h{i}.org", "/", "block") for i in range(300)]]
    for rules in (urlfilter.RULES, many, spark.createDataFrame(urlfilter.RULES, "host string, path string, verdict string")):
        got = {r.page_id: (r.url, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect()}
        assert got == dict(enumerate(URLS))
    assert urlfilter.judge(df.limit(0), urlfilter.RULES).count() == 0


def test_aliases_share_decisions(spark):
    link = '<head><link href="{}" rel="canonical"></head>'
    meta = "<META http-equiv='refresh' content='0; URL={}'>"
    pages = [
        (1, "http://q.example.com/en/1", meta.format("http://b.org/z")),  # blocked, and so are its aliases
        (2, "http://b.org/z", ""),
        (3, "HTTP://B.org/z#f", link.format("w?a=1&amp;b=2")),
        (4, "http://b.org/w?a=1&b=2", None),
        (5, "http://c.org/1", link.format("http://www.example.com/en/9")),  # allowed: goes before the block
        (6, "http://c.org/2", link.format("//c.org/1")),
        (7, "http://c.org/3", link.format("http://example.com/en/3")),
        (8, "http://c.org/2", meta.format("/3")),
        (9, "http://d.org/", "canonical http-equiv"),
        (9, "http://d.org/", "canonical http-equiv"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [(r.page_id, r.verdict) for r in urlfilter.judge(df, urlfilter.RULES).orderBy("page_id").collect()]
    assert got == [(1, "block"), (2, "block"), (3, "block"), (4, "block"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "allow"), (9, "allow"), (9, "allow")]
    extra = spark.createDataFrame([("http://d.org/", "http://x.net/fr/1")], "a string, b string")
    assert {r.verdict for r in urlfilter.judge(df, urlfilter.RULES, extra).where("page_id = 9").collect()} == {"block"}


def test_links_in_text_are_no_links(spark):
    link = '<link rel="canonical" href="http://x.net/es/1">'
    real = '<link rel="canonical" href="http://x.net/fr/1">'
    pages = [
        f"<!-- {link} -->",
        f"<script>var s='{link}'</script>",
        f"<SCRIPT type='x'>\n{link}\n</Script >",
        f"<style>{link}</style><textarea rows=2>{link}</textarea><title>{link}</title>",
        f"<!-- open {link}",
        f"<script>open {link}",
        f"<script>'<!--'</script> <!-- {link} <script> -->",
        f"<!-->{real}",
        f"<!-- {link} -->{real}<!-- {link} -->",
        f'<meta name="a" content="<!--">{real}',
        f"<scripted>{real}</scripted>",
        f"<script>'a'</script>{real}<script>'b'</script>",
        f"<!-- <base href='http://y.org/'> --><link rel=canonical href='//x.net/fr/2'>",
    ]
    df = spark.createDataFrame([(i, f"http://q{i}.org/a", h) for i, h in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(df, urlfilter.RULES).collect()}
    assert got == {i: "allow" if i < 7 else "block" for i in range(len(pages))}
    assert len(urlfilter.link_edges(df).collect()) == len(pages) - 7
    long = "<!--" + "-" * 300_000 + f"{link}" + "<script " * 50_000
    assert urlfilter.link_edges(spark.createDataFrame([(1, "http://q.org/", long)], "page_id long, url string, html string")).collect() == []


def test_relative_targets(spark):
    deep, bare = "http://b.org/x/y/z?q=1#f", "HTTP://B.org"
    want = {
        (deep, ""): "http://b.org/x/y/z?q=1",
        (deep, "../w"): "http://b.org/x/w",
        (deep, "./w"): "http://b.org/x/y/w",
        (deep, "w"): "http://b.org/x/y/w",
        (deep, ".."): "http://b.org/x/",
        (deep, "."): "http://b.org/x/y/",
        (deep, "../../../../w"): "http://b.org/w",
        (deep, "a/./b/../c?p=../d#e"): "http://b.org/x/y/a/c?p=../d",
        (deep, "a//b/..c/..."): "http://b.org/x/y/a//b/..c/...",
        (deep, "?page=2"): "http://b.org/x/y/z?page=2",
        (deep, "#g"): "http://b.org/x/y/z?q=1",
        (deep, "/m/../n"): "http://b.org/n",
        (deep, "//c.org/a/../b"): "http://c.org/b",
        (deep, "//c.org?a"): "http://c.org/?a",
        (deep, "http://d.org/1"): "http://d.org/1",
        (bare, "?page=2"): "http://b.org/?page=2",
        (bare, "../w"): "http://b.org/w",
        (bare, "#g"): "http://b.org/",
    }
    df = spark.createDataFrame(list(want), "url string, target string")
    got = urlfilter.resolved(df).withColumn("key", urlfilter.alias_key(F.col("absolute"))).collect()
    assert {(r.url, r.target): r.key for r in got} == want


def test_relative_aliases_pass_decisions_on(spark):
    link = '<base target="_top"><BASE class="x" href=\'{}\'><link rel="canonical" href="{}">'
    pages = [
        (1, "http://b.org/x/y/1", '<link rel="canonical" href="../z">'),
        (2, "http://b.org/x/z", "<meta http-equiv='refresh' content='0; URL=?page=2'>"),
        (3, "http://b.org/x/z?page=2", '<link rel="canonical" href="./w">'),
        (4, "http://b.org/x/w", link.format("/docs/", "v")),
        (5, "http://b.org/docs/v", link.format("http://c.org/k/", "../u")),
        (6, "http://c.org/u", link.format("http://x.net/fr/", "1")),  # blocked, and so is all that leads to it
        (7, "http://b.org/x/", '<link rel="canonical" href="#top">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = urlfilter.judge(df, [("net", "/fr/", "block")]).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block"] * 6 + ["allow"]
    assert len({r.component_id for r in got[:6]}) == 1


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=60))
def test_components(pairs):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    pairs = [*pairs, *[(100, i) for i in range(101, 160)], *[(200 + i, 201 + i) for i in range(30)]]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in urlfilter.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_url_query(spark):
    df = op3_url_filter(spark, SF)
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
