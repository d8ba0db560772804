"""The corpus pipeline against a plain version of each stage."""

import random

import pytest

import corpus_pipeline
from lexigrid.llm import bpe, quality, secrets

from .helpers import SCHEMA, WORD, odd_documents, prose
from .test_distributed import plain_similar, plain_targets

P = pytest.importorskip("public_tokenizers")


def corpus():
    rnd = random.Random(21)
    data = []
    for i in range(120):
        text = prose(rnd, rnd.randint(25, 300))
        data.append((i, text, "en", rnd.choice(["s1", "s2", "s3"]), len(text)))
    for i in range(30):
        _, text, lang, source, n = data[i]
        data.append((500 + i, text if i % 2 else text + " x", lang, source, n))
    for i in range(10):
        text = prose(rnd, 90) + ' token = "Zk9QpL2mXv8RtY4wBn7Ca3" ' + prose(rnd, 30)
        data.append((600 + i, text, "en", "s1", len(text)))
    return data + [(900, "too short", "en", "s1", 9), (901, None, "en", "s1", None), (902, prose(rnd, 100).upper(), "en", "s2", 1)]


def test_pipeline_equals_plain_stages(spark, tmp_path):
    data = corpus()
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    rules = quality.QualityRules()
    docs = {i: (t, s) for i, t, lang, s, _ in data if quality.measure(t or "", lang, rules)[-1]}
    assert not {900, 901, 902} & set(docs)
    roots = plain_similar([(i, t) for i, (t, _) in docs.items()])
    docs = {i: docs[i] for i in set(roots.values())}
    assert not any(500 + i in docs for i in range(30))
    clean = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame([(i, t, "en", s, 0) for i, (t, s) in docs.items()], SCHEMA)).collect()}
    assert not any("Zk9QpL2" in t for t in clean.values())

    coder, words, by = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN), {}, {}
    for r in got:
        assert r.n_tokens == len(r.ids)
        text = coder.decode(r.ids).decode()
        assert coder.encode(text) == r.ids
        assert set(WORD.findall(text)) <= set(WORD.findall(clean[r.doc_id]))
        words[r.doc_id] = words.get(r.doc_id, 0) + len(WORD.findall(text))
    size = {i: len(WORD.findall(t)) for i, t in clean.items()}
    assert all(words[i] <= 2 * size[i] for i in words)
    for i, (_, s) in docs.items():
        by.setdefault(s, [0, 0])
        by[s][0] += size[i]
        by[s][1] += words.get(i, 0)
    for s, target in plain_targets({s: n for s, (n, _) in by.items()}).items():
        assert abs(by[s][1] - target) <= 0.02 * target + 32


def test_stages_keep_the_columns(spark, tmp_path):
    df = spark.createDataFrame(corpus() + odd_documents()[:20], SCHEMA)
    df.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == df.dtypes
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_repeated_ids_of_unlike_texts(spark, tmp_path):
    rnd = random.Random(22)
    texts = [prose(rnd, 200) for _ in range(12)]
    data = [(i % 4, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(9, texts[0], "en", "s", 1), (2, texts[1] + " more", "en", "s", 1), (None, texts[2], "en", "s", 1)]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    coder = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    taken = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        text = coder.decode(r.ids).decode()
        home = [t for t in texts if set(WORD.findall(text)) <= set(WORD.findall(t + " more"))]
        assert home
        taken[home[0]] = taken.get(home[0], 0) + len(WORD.findall(text))
    assert len(taken) >= 10 and abs(sum(taken.values()) - 1.5 * 12 * 200) <= 100 and max(taken.values()) <= 402
