"""Merge replay against the tiktoken library, runs against a plain search,
resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from gridwork.llm import merge_replay, periodic_runs, queries, target_resampling
from gridwork.llm.common import ship
from gridwork.sources import read_table
from tests.conftest import SF_SMALL

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merge_replay.read_ranks(RANKS), special_tokens={})


def _odd_texts():
    rng = random.Random(11)
    codes = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    bits = [" ", "  ", "\n", "'s", "'re", "'LL", "a", "the", "1", "é", "ж", "!", "　", "\x1c", "\x85", "​", "😀", "𝐀", "aaaa", "\t", "\x00"]
    out = ["".join(rng.choice(codes) if rng.random() < 0.3 else rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    return [*out, "a" * 200_000, " " * 50_000 + "x", "ab" * 20_000, "1" * 9_000, "the cat " * 5_000, " ".join(codes)]


def test_ids_equal_the_library_and_decode_back(library):
    own, texts = merge_replay.coder(RANKS), _odd_texts()
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_rank_tables_not_in_the_order_of_learning():
    """Random tables, where a merge can make a pair of lower rank."""
    rng = random.Random(3)
    for _ in range(40):
        tokens = {bytes(rng.choices(b"ab ", k=rng.randint(2, 5))) for _ in range(25)}
        ranks = {bytes([i]): i for i in range(256)} | {t: 256 + i for i, t in enumerate(sorted(tokens, key=lambda _: rng.random()))}
        lib = tiktoken.Encoding("odd", pat_str=r"[ab ]+", mergeable_ranks=ranks, special_tokens={})
        words = ["".join(rng.choices("ab ", k=rng.randint(1, 30))) for _ in range(60)]
        got = merge_replay.Replay(ranks)([w.encode() for w in words])
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib.encode_ordinary(w) for w in words]


def test_columns_of_ids_and_bytes(spark, library):
    texts = [None, "", "x", "Hello, wörld!", "Hello, wörld!", "\n\n  z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    out = df.select("*", merge_replay.encode(F.col("text"), RANKS).alias("coded"))
    out = out.select("*", merge_replay.decode(F.col("coded"), RANKS).alias("raw")).orderBy("doc_id").collect()
    assert [r.coded for r in out] == [library.encode_ordinary(t or "") for t in texts]
    assert [bytes(r.raw).decode() for r in out] == [t or "" for t in texts]
    assert df.where("false").select(merge_replay.encode(F.col("text"), RANKS)).count() == 0
    assert spark.range(1).select(merge_replay.decode(F.lit(None).cast("array<long>"), RANKS).alias("raw")).first().raw == b""


def test_replay_query_equals_the_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in read_table(spark, SF_SMALL, "documents").collect()}
    rows = queries.QUERIES["op11_merge_replay"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def _runs(words, min_length, min_exponent):
    """Every period compared word by word; of a stretch the least period counts."""
    out = {}
    for q in range(1, len(words) // min_exponent + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(min_length, min_exponent * q):
                out.setdefault((start, length), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


def _collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def _word_lists():
    rng = random.Random(7)
    for _ in range(400):
        kinds = rng.choice([1, 2, 2, 3, 5, 40])
        words = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.6:
            unit, at = [f"w{rng.randrange(kinds)}" for _ in range(rng.randint(1, 6))], rng.randint(0, len(words))
            words[at:at] = (unit * 6)[:rng.randint(1, 30)]
        yield words


@pytest.mark.parametrize("least", [(6, 4), (1, 2), (5, 3), (12, 2)])
def test_runs_equal_a_plain_search(least):
    lists = list(_word_lists())
    for words, (runs, text) in zip(lists, periodic_runs.collapse([" ".join(w) for w in lists], *least), strict=True):
        want = _runs(words, *least)
        assert [tuple(r) for r in runs.tolist()] == want
        assert text == _collapsed(words, want)


def test_trees_of_whole_texts_find_the_same_runs():
    """The stretches set apart beforehand lose nothing."""
    for words in _word_lists():
        number = {w: i for i, w in enumerate(words)}
        row = np.array([number[w] for w in words], np.int64)
        assert [tuple(r) for r in periodic_runs.find_runs(row, 6, 4).tolist()] == _runs(words, 6, 4)


def test_longest_common_extensions():
    rng = random.Random(1)
    row = [rng.randrange(2) for _ in range(300)] + [-1]
    depths, step, rank = periodic_runs.SuffixTree(row).tour()
    least = periodic_runs.RangeMin(depths)
    assert sorted(range(301), key=lambda i: row[i:]) == np.argsort(rank).tolist()
    i, j = np.array([(a, b) for a in range(0, 300, 3) for b in range(300) if a != b]).T
    for a, b, got in zip(i.tolist(), j.tolist(), least(step[i], step[j]).tolist(), strict=True):
        want = next(k for k in range(301) if row[a + k] != row[b + k])
        assert got == want


def test_runs_of_a_column(spark):
    texts = [None, "", " \t\n", "one", "a b a b a b a b", "\x0ba\x0ca a\ra a  a x\xa0y", "q " * 30_000, "z " + "u v w " * 4 + "u", "é é é é é é"]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, runs string")
    rows = df.select("doc_id", periodic_runs.periodic_runs("text").alias("f")).orderBy("doc_id").collect()
    for t, r in zip(texts, rows, strict=True):
        words = [w for w in re.split("[\x20\x09-\x0d]+", t or "") if w]
        want = _runs(words, 6, 4) if len(words) < 1000 else [(0, len(words), 1)]
        assert [(x.start, x.length, x.period) for x in r.f.runs] == want
        assert r.f.collapsed == _collapsed(words, want)
    assert df.where("false").select(periodic_runs.periodic_runs("text")).count() == 0


def _features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def _resample(docs, target, percent, min_words, longest, buckets, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, count in ((docs.values(), s), (target, t)):
        for text in texts:
            for f in _features(text, longest)[1]:
                count[bucket(f)] += 1
    total_s, total_t = float(sum(s) + buckets), float(sum(t) + buckets)
    gain = [math.floor(1000 * math.log((b + 1.0) * total_s / ((a + 1.0) * total_t))) for a, b in zip(s, t, strict=True)]
    out, able = {}, []
    for i, text in docs.items():
        n, found = _features(text, longest)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(found), weight, score, None]
        if n >= min_words:
            able.append((-score, i))
    for place, (_, i) in enumerate(sorted(able)[:percent * len(able) // 100]):
        out[i][3] = place + 1
    return out


@pytest.mark.parametrize("longest", [1, 3])
def test_resampling_equals_plain_python(spark, longest):
    rng = random.Random(9)
    vocabulary = ["A", "b", "Çé", "x1", "THE", "the", "é", "12", "日本"]
    text = lambda: rng.choice([" ", "--", "\x00", "\n."]).join(rng.choices(vocabulary, k=rng.randint(0, 30)))
    docs = {i: text() for i in range(200)} | {500: None, 501: "", 502: "--", -3: "word " * 40_000}
    target = [text() for _ in range(20)] + [None, ""]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs.items()], "doc_id long, text string, rank int, weight int").repartition(5)
    b = spark.createDataFrame([(t,) for t in target], "text string")
    got = target_resampling.resample(d, b, percent=30, min_words=4, longest=longest, buckets=50, seed=7)
    assert {r.doc_id: [r.n_features, r.weight, r.score, r["rank"]] for r in got.collect()} == _resample(docs, target, 30, 4, longest, 50, 7)


def test_resampling_of_nothing_and_of_repeated_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "")], "doc_id long, text string")
    assert target_resampling.resample(none, some).count() == 0
    rows = target_resampling.resample(some, none, percent=100, min_words=1, buckets=10).collect()
    assert sorted(r["rank"] for r in rows if r["rank"]) == [1, 2, 3]
    assert len({(r.weight, r.score) for r in rows if r.doc_id == 1}) == 1


def test_slices_hold_every_text():
    texts = pa.array(["x" * n for n in (0, 5, 40, 3, 0, 70, 1)] + [None])
    whole, target_resampling.PART = target_resampling.PART, 20
    try:
        got = list(target_resampling.parts(texts))
    finally:
        target_resampling.PART = whole
    assert [t for p in got for t in p.to_pylist()] == texts.to_pylist()
    assert all(len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= 20 for p in got)
