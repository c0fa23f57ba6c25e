"""Personal data, chat formatting, language, toxicity and mixing against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwork.llm import compression_toxicity, gru_language, pii_spans, prefix_chat, queries, soft_mixing
from gridwork.llm.common import is_held_out, ship
from tests.conftest import SF_MID, SF_SMALL


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def _luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and _luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def _texts():
    rng = random.Random(5)
    bits = ["a@b.c", "x@", "@", ".", "..", "-", " ", "+1 (017) 555-7713", "+", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "001.255.0.9",
            "256.1.1.1", "12", "7", "é🙂", "me.you+1@mail7.example.com", "GB82 WEST 1234 5698 7654 32", "word", "\n", "123-45-6789", "ssn ", "_"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(400)]
    return [None, "", "7" * 3000, "1 " * 3000, "a" * 20000, "a.b@c." * 300, "+1" * 500, *out]


def test_base_spans_match_plain_search(spark):
    texts = _texts()
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, __pii double")
    for r in pii_spans.personal_data(df).collect():
        base = _base(texts[r.doc_id] or "")
        said = ",".join(f"{k}:{a}:{b}" for a, _, k, b in base)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest(), (texts[r.doc_id], said, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k, _ in base) for x in ("email", "ip", "card", "phone")]
        listed = [s for s in r.spans.split(",") if s]
        assert [s for s in listed if s.split(":")[0] in pii_spans.BASE] == [x for x in said.split(",") if x]
        assert len(listed) == len(r.scores)


def test_added_spans_and_redaction(spark):
    df = spark.createDataFrame([(1, "my ssn 123-45-6789 and GB82 WEST 1234 5698 7654 32.", 3), (2, "code 123-45-6789, GB83 WEST 1234 5698 7654 32", 3),
                                (3, "a@b.co 4111 1111 1111 1111 +1 (017) 555-7713, 10.0.0.1", 3), (4, None, 3), (4, "", 3)], "doc_id int, text string, n_chars long")
    spans = {r.doc_id: r.spans for r in pii_spans.personal_data(df.where("doc_id < 3")).collect()}
    assert spans[1] == "ssn:7:18,iban:23:50" and spans[2] == ""
    got = sorted(pii_spans.redacted(df, "text", "n_chars").collect(), key=str)
    text = {r.doc_id: r.text for r in got}
    assert text[1] == "my ssn <SSN> and <IBAN>." and text[3] == "<EMAIL> <CARD> <PHONE>, <IP>"
    assert sum(r.doc_id == 4 for r in got) == 2 and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert pii_spans.personal_data(df.where("false")).count() == 0


def _added(text):
    """Confirmed IBANs and social security numbers, context read plainly."""
    out = []
    for name, pattern, base, words in (("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?+[A-Z0-9]){11,30}+(?![A-Za-z0-9])", 0.7, r"iban|bank|account|transfer"),
                                       ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.4, r"\bssn\b|social|security")):
        for x in re.finditer(pattern, text):
            code = x[0].replace(" ", "")
            right = (int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 if name == "iban" else not re.search("^(000|666|9)|-00-|-0000$", x[0]))
            near = text[max(0, x.start() - pii_spans.NEAR):x.start()] + " " + text[x.end():x.end() + pii_spans.NEAR]
            points = base + 0.2 * bool(re.search(words, near.lower()))
            if right and points >= 0.5:
                out.append((x.start(), name, x.end(), round(points, 6)))
    return sorted(out)


def test_context_reaches_over_neighbouring_matches(spark):
    rng = random.Random(11)
    numbers = ["123-45-6789", "234-56-7890", "000-12-3456", "345-67-8901", "GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32"]
    words = ["social", "ssn", "account", " ", ", ", "é🙂", "-", "\n", "on file for now", "x" * 17]
    texts = ["social security numbers: 123-45-6789, 234-56-7890, 345-67-8901 on file", "123-45-6789, 234-56-7890, 345-67-8901 (ssn)",
             "security 000-12-3456 234-56-7890", "123-45-6789" + " 234-56-7890" * 300 + " ssn",
             "ssn: 123-45-6789, 234-56-7890, 345-67-8901 on file"]
    texts += [" ".join(rng.choice(numbers if rng.random() < 0.5 else words) for _ in range(rng.randint(2, 12))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii_spans.personal_data(df).collect():
        said = [(int(s.split(":")[1]), s.split(":")[0], int(s.split(":")[2]), round(p, 6)) for s, p in zip(filter(None, r.spans.split(",")), r.scores, strict=True)]
        assert [x for x in said if x[1] in ("iban", "ssn")] == _added(texts[r.doc_id]), texts[r.doc_id]
    got = {r.doc_id: r.text for r in pii_spans.redacted(df).collect()}
    assert got[0] == "social security numbers: <SSN>, <SSN>, 345-67-8901 on file" and got[1] == "<SSN>, <SSN>, <SSN> (ssn)"   # the word is 43 characters off the third
    assert got[4] == "ssn: <SSN>, <SSN>, <SSN> on file"
    assert got[2] == "security 000-12-3456 <SSN>" and got[3] == "123-45-6789" + " 234-56-7890" * 296 + " <SSN>" * 4 + " ssn"


def test_base_scores_reach_over_neighbouring_matches(spark):
    texts = {1: "hosts 10.0.0.1, 10.0.0.2, 10.0.0.3, 10.0.0.4 and 10.0.0.5", 2: "card 12 34 4111111111111111 " + "56 " * 9 + "4111111111111111", 3: "+15550177713 +15550177714 mobile"}
    got = {r.doc_id: r.scores for r in pii_spans.personal_data(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert [round(x, 6) for x in got[1]] == [0.9] * 4 + [0.7] and [round(x, 6) for x in got[3]] == [0.9] * 2


def test_chat_is_read_back(spark):
    evil = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "s#\\n<\\l", 1), (1, 1, "user", evil, 1), (1, 2, "assistant", evil, 1), (1, 3, "assistant", None, 1), (1, 4, "us:\ner", "tail </turn>\n### x:\n", 1),
            (2, 0, "user", "no reply", 1), (3, None, None, None, 1), (3, 1, "assistant", "\\\\l\\h#", 1), (3, 1, "assistant", "\\\\l\\h#", 1), (None, 0, "assistant", "é🙂", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    examples = prefix_chat.expand(df)
    got = {r.conv_id: r for r in prefix_chat.digests(examples).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        said = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    one = examples.where("conv_id = 1 and example = 2").first()
    assert one.text[:one.loss_start].endswith("### assistant:\n") and one.text[one.loss_end:] == "</turn>\n"
    assert examples.where("conv_id = 1").count() == 3 and prefix_chat.expand(df.where("false")).count() == 0


def test_language_held_out(spark):
    got = queries.QUERIES["op8_gru_language"](spark, SF_MID)
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_edges(spark):
    model = gru_language.train([b"the and of that " * 20, b"der die und nicht " * 20], ["en", "de"])
    texts = [None, "", "123 !?", "the and of " * 30000, "der die und"]
    df = spark.createDataFrame([(t, "x") for t in texts], "text string, score string")
    got = [r.p.lang_pred for r in df.select(gru_language.predict(F.col("text"), model).alias("p")).collect()]
    assert got == ["und", "und", "und", "en", "de"]
    assert gru_language.identified(df, model).columns == ["text", "score"] and gru_language.identified(df, model).count() == 2
    empty = gru_language.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert df.select(gru_language.predict(F.col("text"), empty).alias("p")).where("p.lang_pred <> 'und'").count() == 0


def _plain_probabilities(model, window):
    """The network position by position, unit by unit, as its equations say."""
    def sigmoid(x):
        return 1 / (1 + math.exp(-x))
    h, states = gru_language.HIDDEN, []
    for d in (0, 1):
        table, gates, state = model.table[d].tolist(), model.gates[d].tolist(), model.state[d].tolist()
        s, row = [0.0] * h, {}
        for t in (range(len(window)) if not d else reversed(range(len(window)))):
            x = table[window[t]]
            z = [sigmoid(x[i] + sum(s[j] * gates[j][i] for j in range(h))) for i in range(h)]
            r = [sigmoid(x[h + i] + sum(s[j] * gates[j][h + i] for j in range(h))) for i in range(h)]
            c = [math.tanh(x[2 * h + i] + sum(r[j] * s[j] * state[j][i] for j in range(h))) for i in range(h)]
            s = [s[i] + z[i] * (c[i] - s[i]) for i in range(h)]
            row[t] = s
        states.append(row)
    out = []
    for t in range(len(window)):
        both = states[0][t] + states[1][t]
        e = [math.exp(model.bias[k] + sum(both[j] * model.out[j][k] for j in range(2 * h))) for k in range(len(model.languages))]
        out.append([x / sum(e) for x in e])
    return out


def test_gru_forward_equals_plain_pass():
    model = gru_language.train([b"the and of that " * 20, b"der die und nicht " * 20, "les des à été ".encode() * 20], ["en", "de", "fr"])
    rng = np.random.default_rng(5)
    for n in (1, 5, 63, 64, 65, 200):
        text = bytes(rng.integers(0, 256, n).astype(np.uint8))
        rows = [p for i in range(0, n, gru_language.SPAN) for p in _plain_probabilities(model, text[i:i + gru_language.SPAN])]
        assert np.abs(model.pooled([text])[0] - np.mean(rows, axis=0)).max() < 1e-4


def test_gru_gradients_equal_differences():
    rng = np.random.default_rng(6)
    h, k, n = gru_language.HIDDEN, 3, 4
    w = [(0.5 * rng.standard_normal(shape)).astype(np.float32) for shape in ((2, 256, 3 * h), (2, h, 2 * h), (2, h, h), (2 * h, k), (k,))]
    length = np.array([64, 7, 64, 30])
    data = (rng.integers(0, 4, (gru_language.SPAN, n)) * (np.arange(gru_language.SPAN)[:, None] < length)).astype(np.uint8)
    y = np.array([0, 1, 2, 1])
    _, grad = gru_language.loss_and_gradients(w, data, length, y)
    for x, g in zip(w, grad, strict=True):
        for at in [np.unravel_index(i, x.shape) for i in np.argsort(-np.abs(g).reshape(-1))[:6]]:
            kept, ends = x[at], []
            for move in (0.02, -0.02):
                x[at] = kept + np.float32(move)
                ends.append(gru_language.loss_and_gradients(w, data, length, y)[0])
            x[at] = kept
            assert abs((ends[0] - ends[1]) / 0.04 - g[at]) < 0.03 * abs(g[at]) + 2e-4


def test_gru_gradient_learns_order():
    """Windows whose label depends on what came before and after a byte."""
    model = gru_language.train([b"ab" * 100, b"ba" * 100, b"aabb" * 60], ["x", "x", "y"])
    assert model.pooled([b"abababababab", b"aabbaabbaabb"]).argmax(axis=1).tolist() == [0, 1]


def test_toxicity(spark):
    bad = re.compile(r"\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b")
    got = queries.QUERIES["op7_compression_toxicity"](spark, SF_MID.replace("sf0.01", "sf0.1"))
    docs = spark.read.parquet(f"{SF_MID.replace('sf0.01', 'sf0.1')}/documents.parquet").select("doc_id", "text")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    hot = [r.predicted for r in rows if bad.search(r.text)]
    cold = [r.predicted for r in rows if not bad.search(r.text)]
    assert sum(hot) >= 0.9 * len(hot) and sum(cold) <= 0.02 * len(cold) and all(0 <= r.score <= 1 for r in rows)


def test_toxicity_with_few_labels(spark):
    """19 toxic documents to train on: words that only they hold are learned."""
    bad = re.compile(r"\b(trash|pathetic|idiot|disgusting|worthless|stupid|clown|loser|scum|moron)\b")
    got = queries.QUERIES["op7_compression_toxicity"](spark, SF_MID)
    rows = got.join(spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text"), "doc_id").where("held_out").collect()
    hot = [r.predicted for r in rows if bad.search(r.text)]
    cold = [r.predicted for r in rows if not bad.search(r.text)]
    assert sum(hot) >= 0.7 * len(hot) and sum(cold) <= 0.02 * len(cold)


def test_toxicity_learns_from_whole_texts(spark):
    """Wording that begins after 20,000 characters is learned."""
    calm, late = "a quiet day in the garden " * 800, "you utter nincompoop " * 3
    made = [(i, calm + late * (i % 3 == 0), int(i % 3 == 0)) for i in range(150)]
    docs, labels = spark.createDataFrame([m[:2] for m in made], "doc_id long, text string"), spark.createDataFrame([(m[0], m[2]) for m in made], "doc_id long, toxic int")
    model = compression_toxicity.learn(docs, labels)
    df = spark.createDataFrame([(calm,), (calm + late,)], "text string")
    got = [r[0] for r in df.select(compression_toxicity.toxicity(F.col("text"), model)).collect()]
    assert got[0] < compression_toxicity.THRESHOLD <= got[1]


def _sample(spark, ordinary, toxic):
    return spark.createDataFrame([(i, y, t) for i, (y, t) in enumerate([(0, t) for t in ordinary] + [(1, t) for t in toxic])], "_id long, _y int, _t string")


def test_toxicity_weights(spark):
    """A class of which one in ten is sampled counts ten times."""
    made = _sample(spark, ["a quiet day in the garden"] * 40, ["you utter nincompoop"] * 20 + ["a quiet day in the garden"] * 20)
    even, rare = compression_toxicity.fit(made), compression_toxicity.fit(made, (10.0, 1.0))
    assert rare.chance[0] < even.chance[0] / 4 and rare.chance[-1] > 0.5


def test_toxicity_edges(spark):
    model = compression_toxicity.fit(_sample(spark, ["a quiet day in the garden"] * 400, ["you utter nincompoop, nincompoop"] * 200))
    df = spark.createDataFrame([(None,), ("",), ("x" * 300000,), ("a nincompoop",)], "text string")
    got = [r[0] for r in df.select(compression_toxicity.toxicity(F.col("text"), model)).collect()]
    assert got[0] == got[1] and got[3] > got[0] and all(0 <= x <= 1 for x in got)
    assert compression_toxicity.fit(_sample(spark, [], [])).scorer()(["", "x"]).tolist() == [0, 0]


def test_toxicity_learns_from_odd_tables(spark):
    """Null ids, texts and labels, an id of both labels, repeated rows and
    columns of clashing names; and tables without rows."""
    docs = spark.createDataFrame([(None, "x", 1), (1, None, 0), (3, "", 0), (3, "", 0), *[(i, "you utter nincompoop" if i % 2 else "a quiet day", 0) for i in range(4, 300)]],
                                 "doc_id long, text string, _y int")
    labels = spark.createDataFrame([(None, 1), (1, 0), (3, 1), (3, 0), (5, None), (7, 2), *[(i, i % 2) for i in range(8, 300)]], "doc_id long, toxic int").withColumn("text", F.lit("z"))
    model = compression_toxicity.learn(docs, labels)
    got = [r[0] for r in docs.orderBy("doc_id").select(compression_toxicity.toxicity(F.col("text"), model)).collect()]
    assert got[-1] > 0.5 > got[-2]
    for d, x in ((docs.where("false"), labels), (docs, labels.where("false"))):
        empty = compression_toxicity.learn(d, x)
        assert len({r[0] for r in docs.select(compression_toxicity.toxicity(F.col("text"), empty)).collect()}) == 1


def test_dictionaries_hold_the_phrases_worth_most(spark):
    """Against plain counts over the same rows."""
    rng = random.Random(12)
    usual, rude = ["garden", "quiet", "Été", "the", "of", "day"], ["nincompoop", "blockhead", "dunce"]
    texts = [(0, " ".join(rng.choices(usual, k=12))) for _ in range(60)] + [(1, " ".join(rng.choices(usual, k=9) + rng.choices(rude, k=3))) for _ in range(30)]
    base, own = compression_toxicity.train_dictionaries(spark.createDataFrame(texts, "_y int, _t string"))
    seen = [{}, {}]
    for y, t in texts:
        for w in set(re.findall(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", compression_toxicity.normalize(t))):
            seen[y][w] = seen[y].get(w, 0) + 1
    order = sorted((w for w, c in seen[0].items() if c > 2 and len(w) >= 3), key=lambda w: (-seen[0][w] * (len(w) - 2), w))
    assert base == b"".join(b" " + w for w in reversed(order))
    rate = {w: c - 30 * (seen[0].get(w, 0) + 1) / 60 for w, c in seen[1].items()}
    clear = {w: (c - 2 * 30 * (seen[0].get(w, 0) + 1) / 60) / math.sqrt(c) for w, c in seen[1].items() if c >= 2 and len(w) >= 4}
    want = []
    for least in compression_toxicity.CLEAR:
        mine = sorted((w for w, x in clear.items() if x >= least and rate[w] > 0), key=lambda w: (-rate[w] * (len(w) - 2), w))
        want.append(b"".join(b" " + w for w in reversed(mine)) + base)
    assert own == list(dict.fromkeys(want))


def test_window_lengths_and_scores_equal_plain_ones(spark):
    """Each window compressed on its own by the library, bytes counted."""
    import zstandard
    model = compression_toxicity.fit(_sample(spark, ["a quiet day in the garden"] * 60, ["you utter nincompoop, a quiet day"] * 40))
    texts = ["", "nincompoop", "a quiet day, you utter nincompoop " * 9, "x" * 500, "été " * 100]
    out = []
    for t in texts:
        total, data = 0, t.lower().encode()
        for i in range(0, max(1, len(data) - 32), 64):
            size = []
            for d in (model.ordinary, model.toxic):
                params = zstandard.ZstdCompressionParameters.from_level(5, dict_size=len(d), source_size=96, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
                held = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(compression_params=params)
                size.append(len(zstandard.ZstdCompressor(dict_data=held, compression_params=params).compress(data[i:i + 96])))
            total += max(0, size[0] - size[1] - model.excess + 1)
        out.append(model.chance[min(total, len(model.chance) - 1)])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    assert [r.s for r in df.select("i", compression_toxicity.toxicity(F.col("text"), model).alias("s")).orderBy("i").collect()] == out


def test_windows_cover_the_whole_text():
    for n in (0, 1, 95, 96, 97, 160, 161, 1000):
        data = bytes(range(256)) * 5
        parts, seen = compression_toxicity.windows(data[:n]), bytearray()
        for i, p in enumerate(parts):
            assert len(seen) >= i * compression_toxicity.STEP
            seen[i * compression_toxicity.STEP:] = p
        assert bytes(seen) == data[:n]


def test_rates_meet_targets_and_plain_version(spark):
    rng = random.Random(1)
    own = {"x": ["alpha", "gamma"], "y": ["beta", "delta"], "z": ["omega"]}
    made = [(i, rng.choice("xxxyyz")) for i in range(600)]
    docs = spark.createDataFrame([(i, " ".join(rng.choice(own[d] + ["the", "of"] * 3) for _ in range(rng.randint(5, 40)))) for i, d in made], "doc_id long, text string")
    labels = spark.createDataFrame([m for m in made if m[0] % 2], "doc_id long, domain string")
    want = {"x": 0.3, "y": 0.5, "z": 0.2}
    rows = soft_mixing.document_rates(docs, labels, want).collect()
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    assert all(r.n_tokens == words[r.doc_id] for r in rows) and all(abs(sum(r[f"p_{d}"] for d in want) - 1) < 1e-9 for r in rows)
    t, p, rate = (np.array(x, float) for x in ([r.n_tokens for r in rows], [[r[f"p_{d}"] for d in want] for r in rows], [r.rate for r in rows]))
    target = np.array(list(want.values())) * t.sum()
    assert np.abs((t * rate) @ p / target - 1).max() < 1e-3 and rate.min() >= 0
    # the same descent, plainly
    inverse, plain = np.linalg.inv((p * t[:, None]).T @ p), np.ones(len(t))
    for _ in range(200):
        plain = np.maximum(0, plain - p @ (inverse @ ((t * plain) @ p - target)))
    assert np.abs(plain - rate).max() < 1e-2
    for domain, mean in (("x", 0.6), ("y", 0.6)):
        i = list(want).index(domain)
        assert np.mean([p[j, i] for j, r in enumerate(rows) if dict(made)[r.doc_id] == domain]) > mean


def test_word_weights_and_calibration_equal_plain_ones():
    """Weights from counted documents; and at the calibration's end the
    penalised likelihood has no slope left."""
    size, hold = {"a": 30, "b": 10}, {"a": {3: 30, 7: 3}, "b": {3: 10, 7: 9}}
    table = {d: [hold[d].get(b, 0) for b in range(soft_mixing.BUCKETS)] for d in hold}
    weights = soft_mixing.word_weights(table, size)
    for i, d in enumerate(size):
        for b in (3, 7, 9):
            usual = size[d] * (hold["a"].get(b, 0) + hold["b"].get(b, 0)) / 40
            z2 = (hold[d].get(b, 0) - usual) ** 2 / (usual + 1)
            assert abs(weights[i][b] - math.log((hold[d].get(b, 0) + 1) / (usual + 1)) * z2 / (z2 + 16)) < 1e-12
    rng = np.random.default_rng(2)
    marks = rng.choice(["a", "b", "c"], 400, p=[0.6, 0.3, 0.1])
    seen = [(m, (rng.standard_normal(3) + [m == "a", m == "b", 2 * (m == "c")]).tolist()) for m in marks]
    c = soft_mixing.Classifier(["a", "b", "c"], [0.6, 0.3, 0.1], [[0.0]] * 3)
    c.calibrate(seen)
    x, y = np.array([e for _, e in seen]), np.array([["a", "b", "c"].index(m) for m in marks])
    scale = x.std(axis=0)

    def loss(bias, slopes):
        z = x @ slopes.T + bias
        start = np.log([0.6, 0.3, 0.1])
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(400), y]).sum() + 0.5 * ((bias - start) ** 2).sum() + 0.5 * ((slopes * scale) ** 2).sum())
    bias, slopes = np.array(c.bias), np.array(c.slopes)
    for i in range(3):
        for move in (0.01, -0.01):
            assert loss(bias + move * np.eye(3)[i], slopes) > loss(bias, slopes)
            for j in range(3):
                assert loss(bias, slopes + move * np.outer(np.eye(3)[i], np.eye(3)[j])) > loss(bias, slopes)


def test_posteriors_are_calibrated_and_tell_documents_apart(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    marks = queries.domains(spark.read.parquet(f"{SF_MID}/labels.parquet"))
    model = soft_mixing.fit_classifier(docs, marks)
    rows = soft_mixing.memberships(docs, model).join(marks, "doc_id").select("doc_id", "domain", "__mix.*").collect()
    p = np.array([[r[f"p{i}"] for i in range(3)] for r in rows])
    assert np.abs(p.sum(axis=1) - 1).max() < 1e-9 and len({round(x, 9) for x in p[:, 0]}) > 0.8 * len(rows)
    hit = [r.domain == model.domains[int(np.argmax(q))] for r, q in zip(rows, p, strict=True)]
    assert np.mean(hit) > 0.85


def test_targets_out_of_reach_are_said_so(spark, caplog):
    """No nonnegative rates meet these: the least distance is found and
    flagged."""
    parts = [(10.0, (0.7, 0.3)), (5.0, (0.6, 0.4)), (1.0, (0.65, 0.35))]
    scored = spark.createDataFrame([(i, (t, *p)) for i, (t, p) in enumerate(parts)], "i int, __mix struct<tokens:double,p0:double,p1:double>")
    goal = [15.0, 1.0]
    rate, got = soft_mixing.fit_rates(scored, goal)
    t, p = np.array([x for x, _ in parts]), np.array([x for _, x in parts])
    weight = 1 / np.array(goal) ** 2

    def far(r):
        return float((weight * ((t * r) @ p - goal) ** 2).sum())
    best = min(far(np.array([a, b, c])) for a in np.linspace(0, 3, 121) for b in np.linspace(0, 3, 61) for c in (0.0, 1.0))
    r = np.array([x[0] for x in scored.select(rate.alias("r"), "i").orderBy("i").collect()])
    assert got["met"] == [False, False] and far(r) <= best * 1.001 and r.min() >= 0
    assert np.allclose((t * r) @ p, got["after"])
    docs = spark.createDataFrame([(i, "same words in each") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(40)], "doc_id long, domain string")
    rows = soft_mixing.document_rates(docs, labels, {"x": 0.9, "y": 0.1}).collect()
    assert not rows[0].targets_met and rows[0].reached_x < 0.99 and "out of reach" in caplog.text
    said = soft_mixing.report(spark, ["x", "y"], {"targets": [9.0, 1.0], "after": [9.0, 2.0], "met": [True, False]}).collect()
    assert [tuple(r) for r in said] == [("x", 9.0, 9.0, True), ("y", 1.0, 2.0, False)]


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (2, None, "x"), (None, "c", "x"), (3, "", "x")], "doc_id long, text string, domain string")
    labels = spark.createDataFrame([(1, "d"), (None, "d"), (2, None)], "doc_id long, domain string")
    got = soft_mixing.document_rates(docs, labels, {"d": 1.0}).collect()
    assert len(got) == 5 and all(abs(r.rate - 1) < 1e-6 for r in got)
    assert soft_mixing.mixed(docs, labels, {"d": 1.0}, total_tokens=10.0).columns == docs.columns
    assert soft_mixing.mixed(docs, labels, {"d": 1.0}).count() == 5
    assert soft_mixing.document_rates(docs, labels.where("false"), {"d": 1.0}).where("rate <> 1").count() == 0
    assert soft_mixing.document_rates(docs.where("false"), labels, {"d": 1.0}).count() == 0


def test_held_out_split(spark):
    import zlib
    df = spark.range(200).select(F.col("id").alias("doc_id"), is_held_out("doc_id").alias("h"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def test_small_tables_exist():
    assert SF_SMALL.endswith("sf0.001")
