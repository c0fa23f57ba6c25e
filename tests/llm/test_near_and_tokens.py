"""Near-duplicates, exact search and tokens against brute force."""

import random
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyarrow import fs as pafs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridwork.llm import common, pivot_permutation, sorted_lists, suffix_pieces, superminhash, token_frames
from gridwork.llm.common import Memory, components, new_dir, ship

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(20)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(200)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = _groups({x for e in links for x in e}, links)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def _documents():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    out, i = [], 0
    for _ in range(9):
        base = [rng.choice(words) for _ in range(rng.choice([2, 3, 5, 40, 120, 400]))]
        for _ in range(rng.randint(1, 22)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append((i, rng.choice([" ", "\t", " \n"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
            i += 1
    return out + [(i, None), (i + 1, ""), (i + 2, " \t "), (i + 3, "one"), (i + 4, "ONE"), (i + 5, "É x"), (i + 6, "é x"), (i + 7, "v " * 50000)]


@pytest.mark.parametrize(("width", "num"), [(3, 85), (5, 80)])
def test_near_duplicates_brute_force(spark, width, num):
    docs = _documents()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in docs], "doc_id long, text string, n int, sig string").repartition(2)
    got = {r.doc_id: r for r in superminhash.near_duplicates(df, width=width, num=num).collect()}
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = _groups(sets, links)
    assert {i: (len(sets[i]), want[i], want[i] == i) for i in sets} == {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()}
    kept = superminhash.drop_near_duplicates(df, width=width, num=num)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i in sets if want[i] == i)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F"), (None, "a b c d e f"), (2, "x y z u v w"), (3, "x y z u v w")], "doc_id long, text string")
    rows = superminhash.near_duplicates(df).collect()
    assert len(rows) == 6 and {(r.doc_id, r.component_id, r.kept) for r in rows} == {(1, 1, True), (2, 1, False), (3, 1, False), (None, None, True)}
    assert sorted(map(str, (r.doc_id for r in superminhash.drop_near_duplicates(df).collect()))) == ["1", "None"]
    assert superminhash.near_duplicates(df.where("false")).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool, m = rng.integers(0, 2**63, 4000).astype(np.uint64), 128
    sets = [np.unique(pool[:n]) for n in (1, 5, 60, 1000)] + [np.unique(pool[a:a + 300]) for a in (0, 30, 150)]
    sig = superminhash.signatures(sets, m)
    assert (np.sort(sig[0] >> 24) == np.arange(m)).all()                # one element: its ranks are a permutation
    assert (superminhash.signatures([sets[3]], m) == sig[3]).all() and (superminhash.signatures([np.empty(0, np.uint64)], m) == 0xFFFFFFFF).all()
    for a, b, want in ((4, 5, 270 / 330), (4, 6, 150 / 450)):
        assert abs((sig[a] == sig[b]).mean() - want) < 0.12


def _vectors():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((260, 16)).astype(np.float32)
    x[50:110] = x[0] + 0.05 * rng.standard_normal((60, 16))           # a group beyond a small list
    x[110:130] = x[1]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows + [(300, None), (301, [0.0] * 16), (302, [float("nan")] + [1.0] * 15), (303, [None] + [1.0] * 15), (304, [float("inf")] + [1.0] * 15),
                   (305, [1.0, 2.0]), (306, [2.0, 4.0]), (307, [])]


def test_vectors_brute_force(spark):
    rows = _vectors()
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, n int, pivots int").repartition(2)
    fine = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in fine for b in fine if a != b and len(fine[a]) == len(fine[b])
             and fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= 0.95]
    want = _groups([i for i, _ in rows], links)
    got = {r.vec_id: r for r in pivot_permutation.near_duplicate_vectors(df).collect()}
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (sum(a == i for a, _ in links), want[i], want[i] == i) for i, _ in rows}
    assert pivot_permutation.near_duplicate_vectors(df.where("false")).count() == 0


def test_vectors_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (None, [1.0, 0.0])], "vec_id long, embedding array<double>")
    rows = pivot_permutation.near_duplicate_vectors(df).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in rows) == [("1", 2, "1"), ("1", 2, "1"), ("2", 2, "1"), ("None", 0, "None")]


def test_top_k_brute_force(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.standard_normal((230, 12)), 2)
    x[60:70] = x[50]                                                  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(250, None), (300, [float("nan")] * 12), (350, [0.0] * 12), (400, [1e6] * 12)]
    df = spark.createDataFrame([(i, v, True) for i, v in rows], "vec_id long, embedding array<double>, is_query boolean").repartition(2)
    whole = {i: [int(np.floor(256 * c)) for c in v] for i, v in rows if v and np.isfinite(v).all()}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[c], strict=True)), c) for c in whole if c != q)[:5]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    got = sorted(tuple(r) for r in sorted_lists.top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(want)
    assert sorted_lists.top_k(df.where("false")).count() == 0 and sorted_lists.top_k(df.where("vec_id = 50")).count() == 0
    big = spark.createDataFrame([(0, [3e15, -2e15]), (1, [3e15, 1.0]), (2, [-3e15, 7.0]), (3, [1e300, 0.0]), (4, [-1e308, 1e308])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in sorted_lists.top_k(big).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 2**63 - 1), (2, -2**63), (4, -2**63)]


def test_top_k_over_many_blocks(spark, monkeypatch):
    """Blocks of a few candidates and queries, repeated rows, one id with two
    vectors, a third of all rows alike: as by brute force."""
    monkeypatch.setattr(sorted_lists, "CANDIDATES", 40)
    monkeypatch.setattr(sorted_lists, "QUERIES", 3)
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((400, 6)), 2)
    x[::3] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[7], rows[100], (7, x[8].tolist()), (50, x[9].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    whole = sorted({(i, tuple(int(np.floor(256 * c)) for c in v)) for i, v in rows})
    want = []
    for q in range(0, 400, 50):
        scores = {(sum(a * b for a, b in zip(u, v, strict=True)), c) for i, u in whole if i == q for c, v in whole if c != q}
        want += [(q, r + 1, c, s) for r, (s, c) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:5])]
    got = sorted(tuple(r) for r in sorted_lists.top_k(df).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(want)


def test_lists_are_not_read_to_their_end():
    """A query that a few candidates answer far better than the rest stops
    early, and a score known from another block stops it at once."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * rng.standard_normal((2000, 8)) * np.array([8, 1, 1, 1, 1, 1, 1, 1.0]))
    x[:20, 0] += 100_000
    q = np.floor(256 * np.array([[4.0, *[0.1] * 7], [-4.0, *[0.0] * 7]]))
    ids, own, lists = np.arange(2000), np.array([-1, -1]), sorted_lists.Lists(x)
    none = np.full(2, -np.inf)
    left, reads = sorted_lists.block_top_k(lists, q, 5, own, ids, none)
    for i in (0, 1):
        assert set(np.argsort(-(x @ q[i]), kind="stable")[:5]) <= set(left[i]) and len(left[i]) <= 20
    assert reads < 0.5 * 2000 * 9                         # nine lists, one of the second query
    left, least = sorted_lists.block_top_k(lists, q, 5, own, ids, np.array([1e12, 1e12]))
    assert not any(map(len, left)) and least <= reads
    # where all lists matter alike, a score that others reach saves what is known to be in vain
    x = np.floor(256 * rng.standard_normal((2000, 8)))
    q, lists = np.floor(256 * rng.standard_normal((20, 8))), sorted_lists.Lists(x)
    own = np.full(20, -1)
    best = np.sort(q @ x.T, axis=1)
    _, alone = sorted_lists.block_top_k(lists, q, 5, own, ids, np.full(20, -np.inf))
    left, told = sorted_lists.block_top_k(lists, q, 5, own, ids, best[:, -1] * 1.3)
    assert told < 0.8 * alone and alone <= 2000 * 8 * 20


def test_scores_that_doubles_hold_are_matrix_products(monkeypatch):
    """Only sums beyond 2**53 are added up number by number."""
    slow = []
    monkeypatch.setattr(sorted_lists, "_score", lambda a, b: slow.append(1) or sum(map(int.__mul__, a, b)))
    x = np.round(np.random.default_rng(6).standard_normal((60, 5)), 2)
    pdf = pd.DataFrame({"vec_id": [*range(60), 50], "e": [*x.tolist(), x[50].tolist()], "known": np.nan, "is_query": [False] * 60 + [True]})
    got = sorted_lists._resolver(5, 256.0)((5, 0, 0), pdf)
    whole = np.floor(256 * x).astype(int)
    want = sorted((-int(whole[50] @ whole[c]), c) for c in range(60) if c != 50)[:5]
    assert [(-s, c) for c, s in zip(got.vec_id, got.score, strict=True)] == want and not slow


def _texts():
    rng = random.Random(2)
    out = [None, "", " ", "a  b\n\n c", "<|endoftext|> x <|endoftext|>", "日本語 🙂 é", "x" * 20000, "it's  we'll \x1c!\x1c it", "one. Two, three.\nFour"]
    return out + ["".join(rng.choice("abthe 1.,▁é🙂\n'") for _ in range(rng.randint(1, 80))) for _ in range(300)]


def test_memory_reads_lists_once_and_asks_for_each_piece_once():
    asked, m = [], Memory(3)

    def make(new):
        asked.extend(new)
        return {p: p.upper() for p in new}
    assert ["".join(x) for x in m.recall(iter([["a", "b", "a"], ["b", "c"], []]), make)] == ["ABA", "BC", ""]
    assert ["".join(x) for x in m.recall(iter([["d", "d"], ["a"]]), make)] == ["DD", "A"]
    # the young generation is full: what is asked for again comes from the old one
    assert ["".join(x) for x in m.recall(iter([["a", "e", "a"]]), make)] == ["AEA"]
    assert sorted(asked) == ["a", "b", "c", "d", "e"] and set(m.young) == {"a", "e"}


def test_pieces_after_any_white_space_are_encoded_together(monkeypatch):
    library, calls = Tokenizer.from_file(BPE), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch_fast(texts, **options)
    e = token_frames.Encoder(BPE)
    e.tokenizer = Counted()
    text = "one two\nthree\n\nfour\t five\u3000six\r\nit's\xa0x \x1cy"
    assert list(e([text])) == [np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
    assert sum(calls) == 2                                # all that follow white space as one text, and the first word


def test_workers_hand_memory_back_after_their_last_batch(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(common, "tidy", lambda: seen.append("tidy"))

    @common.tidied
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s + 1
    for s in run(iter([pd.Series([1]), pd.Series([2])])):
        seen.append(int(s[0]))
    assert seen == [2, 3, "tidy"]
    assert suffix_pieces.encode(F.col("text"), PIECES) is not None      # its batches' types are still found
    before = pa.total_allocated_bytes()
    monkeypatch.undo()
    common.tidy()
    assert pa.total_allocated_bytes() <= before


def test_token_files(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(3, "a  b\n\n c", 0), (None, "null id", 0)], "doc_id long, text string, file int").repartition(2)
    folder = new_dir(spark, "test-tokens")
    token_frames.write_tokens(df, folder, BPE, 2, chars_per_file=4000)
    rows = sorted(token_frames.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    library = Tokenizer.from_file(BPE)
    ids = {i: library.encode(t or "", add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(texts))]
    at = 0
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        at += len(r.ids)
    some = {r.doc_id: r.ids for r in token_frames.read_tokens(spark, folder, [5, 200, 99999]).collect()}
    assert some == {5: ids[5], 200: ids[200]}
    # a damaged frame is found
    store, root = pafs.FileSystem.from_uri(folder)
    name = spark.read.parquet(f"{folder}/manifest").orderBy("file").first()["name"]
    with store.open_input_file(f"{root}/{name}") as f:
        data = bytearray(f.read())
        entries = token_frames.read_table(f)
    data[int(entries[-1]["offset"]) + 9] ^= 0xFF
    with store.open_output_stream(f"{root}/{name}") as f:
        f.write(bytes(data))
    with store.open_input_file(f"{root}/{name}") as f, pytest.raises(Exception, match="(?i)damaged|corrupt|checksum|decompress"):
        token_frames.read_frame(f, entries[-1], token_frames.zstandard.ZstdDecompressor())
    empty = new_dir(spark, "test-tokens")
    token_frames.write_tokens(df.where("false"), empty, BPE, 2)
    assert token_frames.read_tokens(spark, empty).count() == 0


def test_pieces_match_the_library(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = df.select("doc_id", suffix_pieces.encode(F.col("text"), PIECES).alias("ids")).withColumn("back", suffix_pieces.decode(F.col("ids"), PIECES)).collect()
    for r in rows:
        want = library.encode(texts[r.doc_id] or "")
        assert r.ids == want and r.back == library.decode(want)
    assert df.where("false").select(suffix_pieces.encode(F.col("text"), PIECES)).count() == 0


def test_long_word_and_suffix_array():
    c = suffix_pieces.Codec(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdethion") for _ in range(suffix_pieces.SPAN + 500))
    assert next(c.encode([long])).tolist() == library.encode(long)
    text = np.array([1, 2, 1, 2, 1, 0, 2, 1, 0])
    order = suffix_pieces.suffix_array(text, 9)
    key = [tuple(text[i:i + 9]) for i in order]
    assert key == sorted(key)
