"""The pipeline's stages, each against a plain version on what it was given."""

import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from gridwork.llm import gru_language, queries, soft_mixing, superminhash
from gridwork.llm.common import hash01, ship
from tests.conftest import SF_SMALL


def test_stages(spark):
    ship(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    extra = spark.createDataFrame([(900001, None, "en", "s", None), (900002, "1234 !!", "en", "s", 7), (900003, "", None, None, 0)], docs.schema)
    docs = docs.unionByName(extra).cache()
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, steps[-1], SF_SMALL).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        steps.append(out)
    gone = {r.doc_id for r in docs.select("doc_id").collect()} - {r.doc_id for r in steps[1].collect()}
    assert {900001, 900002, 900003} <= gone and len(gone) <= 4
    kept = {r.doc_id for r in superminhash.near_duplicates(steps[1], width=5, num=80).where("kept").collect()}
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(kept)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted(kept)
    assert steps[3].where(F.col("text").rlike(r"@[a-z0-9]+\.[a-z]") | (F.length("text") != F.col("n_chars"))).count() == 0
    assert {r.doc_id for r in steps[4].collect()} <= kept and steps[4].count() > 0.5 * len(kept)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, steps[4], SF_SMALL)
    text = {r.doc_id: r.text for r in steps[4].collect()}
    rows = last.collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(rows) == steps[4].count() and all(r.ids == library.encode(text[r.doc_id]) and r.round_trip for r in rows)


def _shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _kept_of_groups(texts):
    """The least id of every group linked at 0.8, by comparing all pairs."""
    sets = {i: _shingles(t) for i, t in texts.items()}
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return {i for i in sets if top(i) == i}


def test_run_equals_plain_versions(spark, tmp_path):
    """Planted copies, personal data, texts without letters and clean ones
    through the whole pipeline."""
    ship(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    given = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    base = [r.text for r in given.where("lang = 'en' and length(text) > 600").orderBy("doc_id").limit(3).collect()]
    private = "Write to jane.doe@mail.example.org or +1 (212) 555-0147 from 10.20.30.40 with 4111 1111 1111 1111 and the rest of it in the end"
    words = base[1].split()
    near = " ".join([*words[:40], "otherwise", *words[41:]])
    planted = [(900001, base[0]), (900002, base[0].upper()), (900003, near), (900004, private), (900005, "123 456 --"), (900006, None), (900007, "")]
    docs = given.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in planted], given.schema)).coalesce(2)
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {r.doc_id: r.text for r in docs.collect()}

    # language: the network's own pass over all texts
    model = gru_language.learn(docs)
    found = dict(zip(text, model.pooled([(t or "").encode() for t in text.values()]).max(axis=1), strict=True))
    clear = {i: t for i, t in text.items() if any(map(str.isalpha, t or "")) and found[i] >= 0.3}
    assert {900001, 900002, 900003, 900004} <= set(clear) and not {900005, 900006, 900007} & set(clear)
    kept = _kept_of_groups(clear)
    assert 900004 in kept and not {900001, 900002, 900003} & kept

    # mixing: the same descent in numpy, copies by the id's hash
    third = corpus_pipeline.personal_data(spark, docs.where(F.col("doc_id").isin(sorted(kept))), str(tmp_path))
    scored, domains, _ = soft_mixing.rated(third, queries.domains(labels), queries.MIX)
    held = scored.withColumn("salt", F.lit(3)).select("doc_id", "text", "__mix.*", hash01("doc_id", "salt").alias("h")).collect()
    t, p = np.array([float(r.tokens) for r in held]), np.array([[r[f"p{k}"] for k in range(len(domains))] for r in held])
    goal = t.sum() * np.array([queries.MIX[d] for d in domains]) / sum(queries.MIX[d] for d in domains)
    rate = np.ones(len(t))
    for _ in range(200):
        free = t * (rate > 0)
        rate = np.maximum(0, rate - p @ np.linalg.solve((p * free[:, None]).T @ p + 1e-12 * t.sum() * np.eye(len(domains)), (t * rate) @ p - goal))
    want = Counter({r.doc_id: int(np.floor(x)) + int(r.h < x - np.floor(x)) for r, x in zip(held, rate, strict=True)})
    assert Counter(r.doc_id for r in rows) == +want

    # personal data and pieces
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    written = {r.doc_id: r.text for r in held}
    spans = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|\+[0-9][\x20().0-9-]{8,}[0-9]|4111|10\.20\.30")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert all(r.ids == library.encode(written[r.doc_id]) and r.round_trip for r in rows)
    assert not any(spans.search(x) for x in written.values())
    assert written[900004].startswith("Write to ") and written[900004].endswith(" and the rest of it in the end")
    assert all(written[i] == text[i] for i in written if not re.search(r"[@+]|[0-9][ -]?[0-9][ -]?[0-9]|[0-9]\.[0-9]", text[i]))
