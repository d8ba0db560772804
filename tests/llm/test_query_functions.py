"""The registered queries that have no SQL, run as they are, against plain versions."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lexigrid.llm import bpe, quality, queries, toxicity

from .helpers import SCHEMA, WORD, odd_documents, prose
from .test_distributed import near_copies, plain_components, plain_print
from .test_rules import plain_quality, toxic_data

P = pytest.importorskip("public_tokenizers")


def documents():
    rnd = random.Random(31)
    data = odd_documents() + near_copies(rnd)
    data += [(3000 + i, prose(rnd, rnd.choice([15, 25, 90, 150, 400])), rnd.choice(["en", "en", "fr", "de"]), "s", 1) for i in range(120)]
    data += [(4000 + i, prose(rnd, 120).upper(), "en", "s", 1) for i in range(3)]
    data += [(4100 + i, " ".join(prose(rnd, 1).strip(".") + "###" for _ in range(60)), "en", "s", 1) for i in range(3)]
    return data + [(5000 + i % 40, "a row that comes very often", "en", "s", 1) for i in range(400)] + [(6000, "and one row again and again", "en", "s", 1)] * 300


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("plain")
    spark.createDataFrame(documents(), SCHEMA).write.parquet(str(path / "documents.parquet"))
    return str(path)


def answer(spark, folder, name):
    return sorted(map(tuple, queries.queries()[name](spark, folder).collect()), key=str)


def test_op3(spark, folder):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(path, P.PATTERN).vocab.ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t, *_ in documents():
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert answer(spark, folder, "op3_byte_bpe") == sorted(want, key=str)


def test_op6(spark, folder):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in documents():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 2048))
    assert any(w[3] for w in want)
    assert answer(spark, folder, "op6_token_counts") == sorted(want, key=str)


def plain_classes(text):
    """Shares of the classes by the general category of every character."""
    counts = Counter()
    for c in text:
        kind = unicodedata.category(c)
        if c in " \t\n\x0b\x0c\r":
            name = "blank"
        elif c in "#*$%&|<>@^~_+=\\/`{}[]":
            name = "symbol"
        elif ord(c) > 0xFFFF:
            name = "other"
        elif kind in ("Ll", "Lo", "Lm", "Mn", "Mc"):
            name = "lower"
        elif kind in ("Lu", "Lt"):
            name = "upper"
        else:
            name = {"N": "digit", "Z": "blank", "P": "punctuation", "S": "symbol"}.get(kind[0], "other")
        counts[name] += 1
    return [counts[c] / len(text) for c in ("lower", "upper", "digit", "blank", "punctuation", "symbol", "other")]


def plain_distance(p, q):
    entropy = lambda x: -sum(v * math.log2(v) for v in x if v > 0)
    mid = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    return math.sqrt(max(0.0, entropy(mid) - (entropy(p) + entropy(q)) / 2))


def test_op7(spark, folder):
    want, verdicts = [], Counter()
    for i, t, lang, *_ in documents():
        n, *counts, failed = plain_quality(t or "")
        reference = quality.REFERENCES.get(lang)
        far = [None, None]
        if reference and n >= 20:
            far[0] = plain_distance(plain_classes(t), reference.classes)
        if reference and n >= 100:
            words = Counter(w.strip(".,;:!?\"'()") for w in t.lower().split())
            shares = [words[w] / n for w in reference.words]
            own = list(reference.words.values())
            far[1] = plain_distance([*shares, 1 - sum(shares)], [*own, 1 - sum(own)])
        kept = not failed and (far[0] or 0) <= 0.3 and (far[1] or 0) <= 0.35
        verdicts[failed, kept] += 1
        want.append((i, n, *counts, failed, kept, far))
    assert verdicts[False, False] > 5 and verdicts[False, True] > 50
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept, [r.class_distance, r.word_distance]) for r in queries.op7_quality_rules(spark, folder).collect()]
    got, want = (sorted(x, key=lambda r: str(r[:-1])) for x in (got, want))
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[-1] == [x if x is None else pytest.approx(x, abs=1e-6) for x in w[-1]]


def test_op8(spark, folder):
    data, size = documents(), lambda t: len((t or "").encode()) + 1
    got = queries.op8_sharding(spark, folder).collect()
    want = sorted(((i, size(t), zlib.crc32((t or "").encode()), "bytes", None) for i, t, *_ in data), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got), key=str) == want
    total, shards = Counter(), defaultdict(list)
    for r in got:
        total[r.shard] += r.size
        shards[r.shard].append((r.slot, r.text_crc32))
    even, largest = sum(total.values()) / 16, max(w[1] for w in want)
    assert sum(total.values()) == sum(w[1] for w in want)
    for s in range(1, 16):  # every boundary is within 1 % of a share, or a row, of the even one
        assert abs(sum(total[i] for i in range(s)) - s * even) <= 0.01 * even + largest
    for rows in shards.values():
        rows.sort()
        assert [s for s, _ in rows] == list(range(len(rows)))
        runs = [c for k, (_, c) in enumerate(rows) if not k or rows[k - 1][1] != c]
        assert len(runs) == len(set(runs))  # copies of a text lie side by side
    ordered = [c for s in sorted(shards) for _, c in shards[s] if c]  # null and empty texts have crc 0
    assert sum(a != b for a, b in zip(ordered, ordered[1:], strict=False)) + 1 == len(set(ordered))
    key = {zlib.crc32((t or "").encode()): xxhash.xxh64_intdigest((t or "").encode(), 42) >> 1 for i, t, *_ in data if t}
    assert [key[c] for c in dict.fromkeys(ordered) if c in key] == sorted(key.values())


def test_op9(spark, folder):
    data = documents()
    prints = {t: plain_print(t) for _, t, *_ in data}
    roots, smallest = plain_components({p: p for p in {prints[t] for i, t, *_ in data if i is not None}}), {}
    for i, t, *_ in data:
        if i is not None:
            smallest[roots[prints[t]]] = min(i, smallest.get(roots[prints[t]], i))
    want = [(i, f"{prints[t]:016x}", smallest[roots[prints[t]]] if prints[t] in roots else None) for i, t, *_ in data]
    assert answer(spark, folder, "op9_simhash") == sorted(want, key=str)


def test_op4(spark, folder, tmp_path):
    rnd = random.Random(12)
    data = toxic_data(rnd, 400, 0)
    spark.createDataFrame([(i, t) for i, t, _ in data] + [(0, None), (0, data[0][1]), (None, "x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in data[::2]], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = queries.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 403
    label = {i: y for i, _, y in data}
    assert sum(r.toxic == bool(label[r.doc_id]) for r in got if r.doc_id) >= 0.98 * 399
    assert sorted(got, key=str) == sorted(queries.op4_toxicity(spark, str(tmp_path)).collect(), key=str)


def test_fit_is_the_optimum():
    """Conditions of the minimum of the penalized loss, computed without the solver's code:
    the gradient is zero for the cuts, -l1 * sign for weights, within l1 where a weight is zero."""
    rng = np.random.default_rng(5)
    n, terms, grades, l1 = 400, 12, 3, 3e-2
    x = rng.poisson(0.6, (n, terms)).astype(float)
    latent = x @ np.r_[2.0, 1.5, -1.0, np.zeros(terms - 3)] + rng.logistic(size=n)
    y = np.searchsorted(np.quantile(latent, [0.5, 0.7, 0.9]), latent)
    rows, cols = np.nonzero(x)
    w, cuts = toxicity.fit_cuts(rows, cols, x[rows, cols], y, terms, grades, steps=20000, l1=l1)
    p = 1 / (1 + np.exp(-((x @ w)[:, None] - cuts[None])))
    gap = (p - (y[:, None] > np.arange(grades)[None])) / n
    assert np.abs(gap.sum(axis=0)).max() < 1e-5 and (np.diff(cuts) > 0).all()
    slope = x.T @ gap.sum(axis=1)
    assert (np.abs(slope) <= l1 + 1e-5).all() and np.abs(slope + l1 * np.sign(w))[w != 0].max() < 1e-5
    assert (w[3:] == 0).any() and w[0] > w[1] > 0 > w[2]
    # no other point nearby is better
    loss = lambda v, c: -sum(np.log(np.where(y > j, q, 1 - q)).mean() for j, q in enumerate((1 / (1 + np.exp(-((x @ v)[:, None] - c[None])))).T)) + l1 * np.abs(v).sum()
    best = loss(w, cuts)
    assert all(loss(w + rng.normal(0, 0.02, terms), cuts + rng.normal(0, 0.02, grades)) > best for _ in range(50))
