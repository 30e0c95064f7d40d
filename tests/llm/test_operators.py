"""Each operator against a brute-force version on small tables that hold nulls, empty and long texts, ties and clashing names."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanwood.llm import decontaminate, exchange, grammar, line_dedup, media, near_dedup, packing, quality, queries, secrets, substring_dedup, tokens, url_filter, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, rest string, k0 int, told string, block int, id int, n_lines int, n_words int, leaks int, spans int, score int, row int, media int, node int"


def documents(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "NAÏVE", "x\u00a0y", "a|b", "日本"]
    base = [" ".join(r.choice(vocabulary) for _ in range(70)) for _ in range(6)]
    lines = ["  A common line of text\t", "a COMMON line of text", "short", "another line that returns", ""]
    out = []
    for i in range(n):
        kind = i % 6
        text = base[r.randrange(6)].split() if kind < 3 else [r.choice(vocabulary) for _ in range(r.randrange(90))]
        for _ in range(kind):
            if text:
                text[r.randrange(len(text))] = r.choice(vocabulary)
        for _ in range(r.randrange(5)):
            text.insert(r.randrange(len(text) + 1), "\n" + r.choice(lines) + "\n")
        out.append((i, " ".join(text)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one two"), (n + 4, "one two"), (n + 5, "ab " * 400), (n + 6, "ab " * 300 + "cd"), (n + 7, "\n\n\n")]
    r.shuffle(out)
    return out


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def table(spark, rows):
    extra = ("keep", 7, "told", 1, 2, 3, 4, 5, 6, 8, 9, 10, 11)
    return spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(rows):
    return sorted((i, t or "") for i, t in rows)


def test_word_hashes_follow_the_words(rows):
    texts = [t for _, t in rows]
    got, bounds = words.word_hashes(pa.array(texts))
    want = [WORD.findall(t or "") for t in texts]
    assert np.diff(bounds).tolist() == [len(w) for w in want]
    assert len(set(got.tolist())) == len({x for w in want for x in w})
    long = "word " * 3 + "x" * (5 * words.BLOCK) + " word"
    assert len(words.word_hashes(pa.array([long]))[0]) == 5 and len(set(words.word_hashes(pa.array([long]))[0].tolist())) == 2


# 1


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    raw = re.match(r"[^/?#]*", rest)[0]
    host, path = raw.translate(LOWER), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


def test_url_filter(spark):
    rules = [*url_filter.RULES, *(url_filter.Rule("block", f"h{i}.test", f"/p{i}/") for i in range(20))]  # several mask words
    r = random.Random(2)
    hosts = ["Example.com", "a.example.COM", "notexample.com", "x.net", "example.net", "deep.a.example.net", "y.org", "com", "h3.test", "s.h19.test", "evil.org/x.com", "", "é.org"]
    paths = ["", "/", "/en/", "/en/7", "/en/70", "/de/", "/de/8", "/es/ñ", "/p3/", "/p19/z", "?q=/en/", "#/en/", "/en"]
    urls = [f"{r.choice(['http', 'https', ''])}://{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '?a', '#b'])}" for _ in range(400)] + [None, "", "no scheme", "://", "a://b://com/en/", "http://" + "a." * 3000 + "com/en/" + "x" * 5000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'old' AS host", "1 AS row", "2 AS parts")
    got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.judge_urls(df, rules).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}
    assert url_filter.judge_urls(df.limit(0), rules).columns == ["page_id", "url", "row", "parts", "host", "path", "rule", "verdict"]
    assert {x.verdict for x in url_filter.judge_urls(df, []).collect()} == {"allow"}


# 2


def items(n=30):
    r = random.Random(5)
    vocabulary = [f"b{i}" for i in range(120)]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(20, 40)))) for i in range(n)]


def test_decontamination(spark, table):
    bench = items()
    r = random.Random(6)
    clean = [(1000 + i, " ".join(f"b{r.randrange(120)}" for _ in range(150))) for i in range(40)]
    leaked = [(2000 + i, " ".join(f"w{r.randrange(40)}" for _ in range(r.randrange(200))) + " " + t.upper().replace(" ", ", ") + " tail") for i, t in bench[:10]]
    docs = spark.createDataFrame([*clean, *leaked, (1, None), (2, ""), (2, "")], "doc_id long, text string").selectExpr("*", "1 AS leaks", "2 AS row")
    b = spark.createDataFrame([*bench, (99, None), (98, ""), (97, "b1 b2")], "item_id long, text string")
    found = decontaminate.find_leaks(docs, b)
    assert found.columns == ["doc_id", "text", "row", "leaks"]
    got = {(x.doc_id, y.item_id) for x in found.collect() for y in x.leaks if y.item_id != 97}
    assert got == {(2000 + i, i) for i, _ in bench[:10]}
    kept = decontaminate.drop_leaks(docs, b.where("item_id != 97"))
    assert kept.columns == docs.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted([*(i for i, _ in clean), 1, 2, 2])
    assert decontaminate.find_leaks(docs, b.limit(0)).where("size(leaks) > 0").count() == 0
    assert decontaminate.find_leaks(docs.limit(0), b).count() == 0


def test_wand_retrieves_all_above_the_threshold():
    index = decontaminate.Index(items(60))
    r = random.Random(7)
    for _ in range(200):
        own = [t for t in range(len(index.terms)) if r.random() < r.choice([0.1, 0.5, 0.9])]
        score = {}
        for t in own:
            for i, v in index.lists[t]:
                score[i] = score.get(i, 0) + v
        for least in (0.2, 0.5, 0.7):
            assert sorted(i for i, _ in index.search(own, least)) == sorted(i for i, v in score.items() if v >= least)


def test_decontamination_by_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", 2000)
    bench = items()
    docs = spark.createDataFrame([(i, t) for i, t in bench], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert all(x.doc_id in {y.item_id for y in x.leaks} for x in got.collect())


def test_decontamination_finds_items_of_few_words(spark):
    bench = [(1, "42"), (2, "Paris?"), (3, "two words"), (4, "?"), *((10 + i, t) for i, t in items())]
    rows = [(0, "the answer is 42, they say"), (1, "PARIS"), (2, "some two words here"), (3, "two other things"), (4, "142 ? parisian"), (5, "42 in Paris")]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert {(x.doc_id, y.item_id) for x in got.collect() for y in x.leaks} == {(0, 1), (1, 2), (2, 3), (5, 1), (5, 2)}


def test_blocks_of_the_benchmark_find_what_one_index_finds(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = [f"z{int(r.paretovariate(0.6))}" for _ in range(4000)]
    bench = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(15, 60)))) for i in range(300)] + [(None, "a word of no number here")]
    bench += [(400 + i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(600, 900)))) for i in range(3)] + [(7, bench[9][1])]
    rows = []
    for i, t in bench:
        own = t.split()
        for share in (0.5, 0.55, 0.6, 0.65, 0.7):
            size = round(share * len(own))
            at = r.randrange(len(own) - size + 1)
            rows.append((len(rows), " ".join(own[at : at + size])))
    rows += [(-1, " ".join(t for _, t in bench[:40])), (-2, None)]
    docs, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    want = sorted((x.doc_id, x.leaks) for x in decontaminate.find_leaks(docs, b).collect())
    assert 100 < sum(bool(x) for _, x in want) < len(rows) - 100
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", sum(len(t) for _, t in bench))  # five blocks
    assert sorted((x.doc_id, x.leaks) for x in decontaminate.find_leaks(docs, b).collect()) == want


def test_decontamination_counts_all_words_of_long_items(spark):
    word = [f"p{i}" for i in range(900)]
    long = " ".join(word[:800]) + "? " + " ".join(word[800:])
    huge = " ".join(f"h{i}" for i in range(5000))
    filler = " ".join(f"f{i}" for i in range(700))
    bench = spark.createDataFrame([*items(), (500, long), (501, huge)], "item_id long, text string")
    rows = [(0, " ".join([filler, *word[300:], filler])), (1, " ".join([filler, *word[:512], filler])), (2, f"{filler} {huge} {filler}"), (3, f"{filler} {items()[7][1]} {filler}"), (4, filler)]
    got = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(x.doc_id, y.item_id) for x in got.collect() for y in x.leaks} == {(0, 500), (2, 501), (3, 7)}
    assert [x.size for x in decontaminate.indexes([*items(), (500, long), (501, huge)])] == [max(len(t.split()) for _, t in items()), 900, 5000]


# 3 and 6


def ids_of(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ODD = ["a\tb c\n\n  d  ", "x\x1cy \x85z", "don't I'LL 12½ ²3 _a_b", "日本 語 text\u2003x", "é\u0301 \u0301", "  ", "", "\n", "<|endoftext|> a<|endoftext|>", "Σας ΣΑΣ", "İstanbul ß ẞ", " !!", "a" * 500, None]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_remembered_ids_are_the_librarys(name, rows):
    r = random.Random(3)
    texts = ODD + [t for _, t in rows] + ["".join(r.choice("ab é'sSt12½.,!  \n\t\xa0_-ĀЖ日") for _ in range(r.randrange(30))) for _ in range(2000)]
    want = [np.array(x, "<u4").tobytes() for x in ids_of(name, texts)]
    assert list(tokens.encoded(public_tokenizers.path(name), pa.array(texts))) == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_remembered_ids_do_not_depend_on_slices_or_memory(name, rows, monkeypatch):
    texts = ODD + [t for _, t in rows] + ["don't we'll 'tis " * 50, "x" * 40 + " 'S's"]
    want = list(tokens.Encoder(public_tokenizers.path(name)).encode([t or "" for t in texts]))
    monkeypatch.setattr(tokens, "SLICE", 7)
    monkeypatch.setattr(tokens, "MOST", 20)
    assert tokens.Encoder(public_tokenizers.path(name)).encode([t or "" for t in texts]) == want


def test_packing(spark, table, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    long = spark.createDataFrame([(500, "lorem ipsum dolor " * 4000)], "doc_id long, text string")
    df = table.select("doc_id", "text").unionByName(long)
    want = {i: [*x, 1] for i, x in zip([500, *(i for i, _ in rows)], ids_of("word_bpe_49k.json", ["lorem ipsum dolor " * 4000, *(t for _, t in rows)]))}
    pieces = packing.pack_documents(df, path, 1).collect()
    documents_, sequences = {}, {}
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == want[p.doc_id][p.start : p.start + p.length]
        assert p.doc_tokens == len(want[p.doc_id])
        documents_.setdefault(p.doc_id, []).append((p.start, p.length))
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert documents_.keys() == want.keys()
    for group, size in [*((v, len(want[k])) for k, v in documents_.items()), *((v, None) for v in sequences.values())]:
        at = 0
        for start, length in sorted(group):
            assert start == at
            at += length
        assert at == size if size else at <= packing.SIZE
    sizes = [sum(n for _, n in v) for v in sequences.values()]
    assert sum(n == packing.SIZE for n in sizes) >= len(sizes) - 1  # only the last is padded
    assert packing.pack_documents(empty, path, 1).count() == 0


def test_packer_emits_the_fullest():
    packer = packing.Packer(10, 2, 3)
    for n in (6, 7, 8):
        packer.add(("d", 0, n, bytes(4 * n)))
    assert [[len(p[3]) // 4 for p in w] for w in packer.done] == [[7, 3]]
    assert sorted(len(p[3]) // 4 for p in packer.rest()) == [5, 6]


def test_token_shards(spark, table, rows, empty, monkeypatch):
    monkeypatch.setattr(grammar, "SHARD_IDS", 700)
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards = grammar.encode_to_shards(table, path, 0)
    assert shards.count() > 5
    got = sorted(grammar.read_shards(shards).collect())
    at = 0
    for r, (i, text), ids in zip(got, ordered(rows), ids_of("byte_bpe_50k.json", [t for _, t in ordered(rows)]), strict=True):
        assert (r.doc_id, r.start, r.n_tokens) == (i, at, len(ids) + 1)
        assert np.frombuffer(r.ids, "<u4").tolist() == [*ids, 0]
        at += len(ids) + 1
    assert grammar.read_shards(grammar.encode_to_shards(empty, path, 0)).count() == 0


def test_grammar_replaces_until_nothing_is_frequent():
    r = np.random.default_rng(4)
    for ids in (np.tile(r.integers(0, 50000, 2000), 100), np.zeros(5000, np.int64), np.tile([1, 2, 2, 1, 1], 700)):
        seq, rules, first = grammar.compress(ids.astype(np.uint32))
        pairs, counts = np.unique(np.column_stack([seq[:-1], seq[1:]]), axis=0, return_counts=True)
        assert len(seq) < len(ids) / 40 and (not len(counts) or counts.max() < grammar.LEAST_COUNT)
        flat, where = grammar.expansions(rules, first)
        assert np.array_equal(grammar._expand(seq.astype(np.int64), flat, where, first)[0], ids)


def test_grammar_round_trip_and_random_access():
    r = np.random.default_rng(4)
    for ids in (np.zeros(0, np.uint32), np.zeros(5000, np.uint32), r.integers(0, 50000, 3000).astype(np.uint32), np.tile(r.integers(0, 70000, 37), 300).astype(np.uint32), r.zipf(1.3, 20000).clip(0, 60000).astype(np.uint32)):
        shard = grammar.Shard(grammar.pack([1], [len(ids)], ids))
        assert np.array_equal(shard.decode(0, len(ids)), ids)
        for _ in range(50):
            a, b = sorted(r.integers(0, len(ids) + 1, 2).tolist())
            assert np.array_equal(shard.decode(a, b), ids[a:b])
    assert len(grammar.compress(np.tile(np.arange(8, dtype=np.uint32), 500))[0]) <= 1000


# 4


def components(rows, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


@pytest.mark.parametrize("percent", [85, 60])
def test_near_duplicates(table, rows, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table, percent=percent).collect()}
    assert got == components(rows, percent)


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """A loosely similar group much larger than a block, of short and long members, with no list dealt by slices."""
    for name, value in (("BLOCK", 8), ("BLOCK_SHINGLES", 900), ("SLICES", 4), ("SPREAD", 1)):
        monkeypatch.setattr(near_dedup, name, value)
    r = np.random.default_rng(8)
    rows = []
    for i in range(70):
        words = [f"w{j}" for j in range(150 if i % 2 else 400)]
        for at in r.integers(0, len(words), int(r.integers(1, 5))):
            words[at] = f"x{r.integers(0, 30)}"
        rows.append((i, " ".join(words)))
    got = {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == components(rows, 85)


def test_long_lists_are_dealt_like_short_ones(spark):
    posted = [(n, n % 7) for n in range(200)] + [(n, 100) for n in range(200)] + [(n, 200 + n) for n in range(200)]
    lists = {p: sum(x == p for _, x in posted) for _, p in posted}
    posted = spark.createDataFrame(posted, "node long, pair long").repartition(3).cache()
    told = posted.groupBy("pair").agg(F.count("*").alias("freq"), near_dedup._slices(10000)).where("freq > 1")
    out = near_dedup._with_list(posted, told, 10000)
    assert sorted((x.node, x.pair, x.freq) for x in out.collect()) == sorted((n, p, lists[p]) for n, p in posted.collect() if lists[p] > 1)
    assert all(1 < bin(x.slices & (1 << 64) - 1).count("1") <= min(x.freq, near_dedup.SLICES) for x in told.collect())
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftOuter" not in plan and "Broadcast" not in plan  # the postings are joined once only, whatever lists there are


def test_near_duplicates_of_odd_rows(spark, empty):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(5, text), (5, text), (3, text + " x"), (None, text), (7, None), (7, "")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(-1, 46, None, True), (3, 47, 3, True), (5, 46, 3, False), (5, 46, 3, False), (7, 0, 7, True), (7, 0, 7, True)]
    assert near_dedup.near_duplicates(empty).count() == 0


# 5


def png(width=1):
    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", width.to_bytes(4, "big") + b"\0\0\0\1\x08\0\0\0\0") + chunk(b"IDAT", zlib.compress(b"\0" * (width + 1))) + chunk(b"IEND", b"")


def test_media_sniffing(spark):
    import gzip

    wav = media.store_as_wav(b"hello")
    broken = png()[:-6] + b"\0" * 6
    values = {"wav": wav, "png": png(), "gz": gzip.compress(b"abc", mtime=0), "text": b"BM and RIFF and PK\x03\x04", "inside": b"junk" + png() + b"more" + gzip.compress(b"x", mtime=0), "broken": broken, "in wav": media.store_as_wav(png(200)), "empty": b"", "null": None}
    df = spark.createDataFrame([(k, v, "image/png") for k, v in values.items()], "name string, media binary, declared string").selectExpr("*", "1 AS row", "2 AS embedded")
    got = {r.name: r for r in media.sniff_media(df, declared="declared").collect()}
    assert {k: r.media_type for k, r in got.items()} == {"wav": "audio/wav", "png": "image/png", "gz": "application/gzip", "text": media.UNKNOWN, "inside": media.UNKNOWN, "broken": media.UNKNOWN, "in wav": "audio/wav", "empty": media.UNKNOWN, "null": None}
    assert not got["png"].corrected and got["wav"].corrected
    assert [(x.kind, x.start, x.length) for x in got["inside"].embedded] == [("image/png", 4, len(png())), ("application/gzip", 8 + len(png()), len(gzip.compress(b"x", mtime=0)))]
    assert [(x.kind, x.start) for x in got["in wav"].embedded] == [("image/png", 44)]
    assert not got["text"].embedded and not got["broken"].embedded
    carved = media.carve_media(media.sniff_media(df.withColumn("kind", df.name), declared="declared"))
    assert carved.columns == ["name", "declared", "row", "media_type", "corrected", "kind", "start", "length", "data"]
    assert {(r.name, r.kind, bytes(r.data)) for r in carved.collect()} == {("inside", "image/png", png()), ("inside", "application/gzip", gzip.compress(b"x", mtime=0)), ("in wav", "image/png", png(200))}


def test_media_query_corrects_the_declared_type(spark, sf_dir):
    for r in queries.op5_media_sniffing(spark, sf_dir).select("feature").distinct().collect():
        assert r.feature.startswith("audio/wav not text/plain pcm_u8 ")


def test_archives_and_documents_end_where_they_say():
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(3):
            z.writestr(f"{i}.txt", "text" * i)
    archive, pdf = out.getvalue(), b"%PDF-1.4 body startxref 9 %%EOF"
    magic = media.automaton()
    assert media.sniff(archive, magic)[0] == ("application/zip", 0, len(archive))
    assert media.sniff(b"ab" + archive + b"cd" + pdf + b"ef", magic) == [("application/zip", 2, len(archive)), ("application/pdf", 4 + len(archive), len(pdf))]
    assert media.sniff(b"PK\x03\x04%PDF-1.4" * 100_000, magic) == []


def test_media_round_trip(table, rows):
    got = {r.doc_id: r for r in media.read_back(media.sniff_media(media.texts_to_media(table.select("doc_id", "text")))).collect()}
    for i, t in rows:
        data = (t or "").encode()
        assert got[i].n_bytes == len(data)
        assert len(got[i].payload) % 192 == 0 and len(got[i].payload) - len(data) <= 192 and got[i].payload
        assert bytes(got[i].payload) == data + b" " * (len(got[i].payload) - len(data))
        assert got[i].media_type == "audio/wav"


# 7


def test_quality(spark, empty):
    r = random.Random(8)
    good = lambda: ". ".join("The " + " ".join(r.choice(["tree", "river", "stone", "light"]) for _ in range(8)) for _ in range(r.randrange(1, 30)))
    bad = lambda: " ".join(r.choice(["BUY", "NOW", "$$$", "!!!", "CLICK"]) + "***" for _ in range(r.randrange(3, 200)))
    texts = [(i, bad() if i % 4 == 0 else good()) for i in range(300)]
    df = spark.createDataFrame([*texts, (900, None), (901, ""), (None, "x")], "doc_id long, text string").selectExpr("*", "'old' AS score", "1 AS row")
    labels = spark.createDataFrame([*((i, int(i % 4 != 0)) for i in range(300)), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    out = quality.score(df, quality.train(df, labels))
    assert out.columns == ["doc_id", "text", "row", "held_out", "score", "predicted"]
    got = {x.doc_id: x for x in out.collect()}
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(300)) and not got[None].held_out
    assert sum(got[i].predicted == int(i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert {x.score for x in quality.score(df, quality.train(df, labels.limit(0))).collect()} == {0.5}
    assert quality.score(empty, quality.train(empty, labels)).count() == 0


def test_quality_takes_one_row_of_each_sampled_id(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 20)
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda x, first, y: sizes.append((len(y), x.tobytes(), y.tolist())))
    rows = [(i, f"text {i} of its own") for i in range(40)] + [(i, f"copy {j} " * 5) for i in (3, 7, 8) for j in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for seed, parts in ((1, 2), (2, 7)):
        random.Random(seed).shuffle(rows)
        quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), labels)
    assert sizes[0][0] == 20 and sizes[0] == sizes[1]


def test_gradient_is_the_losss():
    r = np.random.default_rng(1)
    x, first, y = r.normal(size=(30, quality.WIDTH)).astype(np.float32), np.array([0, 4, 9, 18, 30]), np.array([0, 1, 1, 0], np.float32)
    before = quality.fit(x, first, y)
    p = before.scores(x, first)
    assert ((p > 0.5) == (y > 0.5)).all()


# 8


def test_line_dedup(spark, table, rows, empty):
    key = lambda line: line.strip(" \t\n\v\f\r").translate(LOWER)
    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(i)
    out = line_dedup.drop_repeated_lines(table)
    assert out.columns == [c for c in table.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(held[key(x)]) > 1 and min(held[key(x)]) != i)]
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
        assert (got[i].rest, got[i].told) == ("keep", "told")
    assert line_dedup.drop_repeated_lines(empty).count() == 0
    odd = spark.createDataFrame([(5, "a repeated line\nown"), (5, "a repeated line"), (2, "A repeated LINE "), (None, "a repeated line")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.text) for r in line_dedup.drop_repeated_lines(odd).collect()) == [(-1, "a repeated line"), (2, "A repeated LINE "), (5, ""), (5, "own")]


def test_shards_are_told_apart_wherever_batches_end():
    shard = np.repeat([3, 4, 9, 11], [5, 1, 7, 2])
    values = [bytes([i]) * (i + 1) for i in range(len(shard))]
    whole = pa.record_batch({"shard": pa.array(shard), "c0": pa.array(values, pa.binary())})
    for size in (1, 2, 5, 6, 100):
        got = {s: list(parts) for s, parts in ((s, list(p)) for s, p in exchange._by_shard(whole.slice(i, size) for i in range(0, len(whole), size)))}
        assert list(got) == [3, 4, 9, 11]
        for s, parts in got.items():
            own = [v for v, of in zip(values, shard) if of == s]
            assert b"".join(bytes(exchange._packed(p.column("c0"))) for p in parts) == b"".join(own)
            assert np.concatenate([np.diff(exchange._offsets(p.column("c0"))) for p in parts]).tolist() == [len(v) for v in own]


def test_many_shards_of_small_blocks_in_few_partitions(spark, table, rows, monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK_BYTES", 300)
    monkeypatch.setattr(exchange, "MOST_PARTITIONS", 2)
    monkeypatch.setattr(exchange, "REPLIES", 3)
    lines = {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(table).collect()}
    default = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {r.doc_id: (r.n_dropped, r.text) for r in line_dedup.drop_repeated_lines(table).collect()} == lines
        got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.drop_repeated_windows(table).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", default)
    assert got == without_repeats(rows)


def test_bloom_has_no_false_negatives():
    h = np.random.default_rng(2).integers(0, 1 << 63, 5000).astype(np.uint64)
    bloom = line_dedup.Bloom(2500)
    bloom.add(h[:2500])
    assert bloom.has(h[:2500]).all() and bloom.has(h[2500:]).mean() < 0.02


# 9


def without_repeats(rows):
    seen, out = set(), {}
    for i, t in ordered(rows):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            window = tuple(w[s : s + 20])
            if window in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(window)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring_dedup(table, rows, empty):
    out = substring_dedup.drop_repeated_windows(table)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in out.collect()}
    assert got == without_repeats(rows)
    assert sum(v[1] for v in got.values()) > 500
    assert substring_dedup.drop_repeated_windows(empty).count() == 0


def test_substring_dedup_of_periodic_texts(spark):
    r = random.Random(11)
    texts = []
    for i in range(60):  # few words, so runs and short periods of all kinds
        unit = [r.choice("ab") for _ in range(r.randrange(1, 6))]
        texts.append((i, " ".join((unit * 40)[: r.randrange(15, 90)] + [r.choice("abc") for _ in range(r.randrange(25))])))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {x.doc_id: (x.n_words, x.n_removed, x.text) for x in substring_dedup.drop_repeated_windows(df).collect()}
    assert got == without_repeats(texts)


def test_windows_under_one_symbol_are_dealt_over_all_shards(spark, monkeypatch):
    r, loads = random.Random(5), []

    def ask(table, send, answer, kinds, n):
        load = np.zeros(n, int)
        for block in exchange.rows_of(table.toArrow().to_batches()):
            for b in send(block):
                load[b.column("shard").to_numpy()] += [len(x) // np.dtype(kinds[0]).itemsize for x in b.column("c0").to_pylist()]
        loads.append(load)
        return exchange.ask(table, send, answer, kinds, n)

    monkeypatch.setattr(substring_dedup, "ask", ask)
    other = lambda: [f"w{r.randrange(1 << 40)}" for _ in range(30)]
    texts = [(i, " ".join([*other(), *"one phrase that every text has in it somewhere".split(), *other()])) for i in range(400)]
    out = substring_dedup.drop_repeated_windows(spark.createDataFrame(texts, "doc_id long, text string"))
    assert {x.doc_id: (x.n_words, x.n_removed, x.text) for x in out.collect()} == without_repeats(texts)
    asked = loads[1]
    assert asked.sum() > 3000
    assert asked.max() < 4 * asked.mean()


def test_windows_are_compared_in_little_memory():
    r = np.random.default_rng(8)
    n = 1 << 18
    hashes, ids = words.mix(r.integers(0, n // 2, n).astype(np.uint64)), r.integers(0, 50, n)
    seen, want = set(), np.zeros(n, bool)
    for i in np.argsort(ids, kind="stable").tolist():
        want[i] = int(hashes[i]) in seen
        seen.add(int(hashes[i]))
    tracemalloc.start()
    got = substring_dedup._started_before(hashes, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all()
    assert peak < 16 * n  # no more than the windows themselves


def test_a_shards_slices_are_not_held():
    slices = lambda: (pa.record_batch({"block": pa.array([i]), "c0": pa.array([bytes([i]) * (1 << 20)], pa.binary())}) for i in range(32))
    before = pa.total_allocated_bytes()
    held = []

    def watched():
        for x in slices():
            held.append(pa.total_allocated_bytes() - before)
            yield x
            del x

    number, size, (data,) = exchange._gathered(watched(), ["c0"], ["u1"])
    assert number.tolist() == list(range(32)) and size.tolist() == [1 << 20] * 32
    assert (data.reshape(32, -1) == np.arange(32, dtype=np.uint8)[:, None]).all()
    assert max(held) < 8 << 20


def test_symbols_depend_on_their_context_only():
    r = np.random.default_rng(3)
    names = words.mix(np.arange(6, dtype=np.uint64))
    inner = names[r.integers(0, 6, 60)]
    a, b = (np.concatenate([names[r.integers(0, 6, n)], inner, names[r.integers(0, 6, n)]]) for n in (13, 40))
    for x, y in zip(substring_dedup.parse(a, np.array([0, len(a)])), substring_dedup.parse(b, np.array([0, len(b)]))):
        own = [{(int(n), lo - s, hi - s) for n, lo, hi in zip(z.name, z.low, z.high) if lo >= s and hi <= s + 60} for z, s in ((x, 13), (y, 40))]
        assert own[0] == own[1] and len(own[0]) > 5


# 10

ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(spark):
    r = random.Random(12)
    parts = ["password", "token", "api_key", "APIKEY", "Secret", "passwd", ":", "=", " ", "'", '"', "abc", "AKIA", "ABCD1234", "deadbeef", "0123", "_", "-", "é", "x.y/", "\t", "zzzzzz", "\n"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(1500)]
    texts += [None, "", "x" * 5000 + " token=" + "a1" * 20, "token: api_key='abcdefghijklmnop'", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "ſecret=abcdefghijklmnop"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 AS spans", "2 AS row")
    found = 0
    for x in secrets.scan_secrets(df).collect():
        got = [(s.start, secrets.BASE.index(s.kind), s.end) for s in x.spans if s.kind in secrets.BASE]
        assert got == base_spans(texts[x.doc_id] or "")
        found += len(got)
    assert found > 100
    kinds = {s.kind for x in secrets.scan_secrets(df).collect() for s in x.spans}
    assert {"pem", "github"} <= kinds


def test_secrets_of_lines_of_any_kind():
    r = random.Random(13)
    parts = ["eyJ", ".", "eyJa", "-", "_", "xoxb-", "ghp_", "AKIA", "0f", "token=", "zz9", " "]
    scan = secrets.Scanner()
    for _ in range(1500):
        line = "".join(r.choice(parts) for _ in range(r.randrange(1, 40)))
        want = []
        for k, rule in enumerate(secrets.RULES):
            for m in re.finditer(f"(?i:{rule.pattern})" if rule.fold else rule.pattern, line):
                if m.end() - scan._value(rule, line.encode(), m.start(), m.end()) >= rule.least:
                    want.append((m.start(), k, m.end()))
        assert scan.spans(line.encode()) == sorted(want)


@pytest.mark.parametrize("part", ["0123456789abcdef", "eyJ", "eyJa.eyJ", "AKIA", "xoxb-", "ghp_", "-----BEGIN ", "password ", "token"])
def test_secret_scans_take_time_in_proportion_to_a_line(part):
    scan = secrets.Scanner()
    steps = []
    scan.walk = [_Counted(row, steps) for row in scan.walk]
    scan.spans((part * 3000).encode())
    assert len(steps) < 20 * 3000 * len(part)


class _Counted(list):
    """A list that notes each look-up."""

    def __init__(self, values, steps):
        super().__init__(values)
        self.steps = steps

    def __getitem__(self, i):
        self.steps.append(i)
        return super().__getitem__(i)


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
