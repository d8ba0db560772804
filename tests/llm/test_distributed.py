"""Mixing, sharding, SimHash groups and top-k search against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lexigrid.llm import mixing, neardup, sharding, simhash, topk

from .helpers import SCHEMA, WORD, frame, odd_documents, prose, rows


# --- mixing --------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, left, out = 1.5 * sum(sizes.values()), set(names), {}
    while left:
        share = (total - sum(out.values())) / sum(weight[s] for s in left)
        above = [s for s in left if share * weight[s] > 2 * sizes[s]]
        if not above:
            return out | {s: share * weight[s] for s in left}
        out |= {s: 2.0 * sizes[s] for s in above}
        left -= set(above)
    return out


def plain_seats(votes, seats):
    won = Counter()
    for _ in range(seats):
        best = min(votes, key=lambda u: (-votes[u] / (2 * won[u] + 1), u))
        won[best] += 1
    return won


def test_apportion_is_sainte_lague(spark):
    rnd = random.Random(4)
    for seats in (0, 1, 7, 50, 333):
        groups = {g: {i: rnd.choice([0, 1, rnd.randint(1, 40), rnd.randint(1, 4000)]) for i in range(rnd.randint(1, 12))} for g in range(4)}
        df = spark.createDataFrame([(g, i, v, seats) for g, units in groups.items() for i, v in units.items()], "g int, u int, v long, n long")
        got = {(r.g, r.u): r.won for r in mixing.apportion(df, ["g"], "v", "n", "u", "won").collect()}
        for g, units in groups.items():
            voted = {u: v for u, v in units.items() if v}
            want = plain_seats(voted, seats) if voted else {}
            assert {u: got[g, u] for u in units} == {u: want.get(u, 0) for u in units}


def big_corpus(rnd, n=900):
    sources = ["a"] * 6 + ["b", "B", "é", None]
    return [(i, prose(rnd, int(10 ** rnd.uniform(0.5, 3))), "en", rnd.choice(sources), 0) for i in range(n)]


def check_mix(data, got):
    size, by = {}, Counter()
    for i, t, _, s, _ in data:
        size[i] = len(WORD.findall(t or ""))
        by[s] += size[i]
    want, taken = plain_targets(by), Counter()
    for i, s, n, total, target, took in got:
        assert n == size[i] and total == by[s] and target == pytest.approx(want[s]) and 0 <= took <= 2 * n
        taken[s] += took
    return want, taken


def test_mix(spark):
    data = big_corpus(random.Random(6))
    df = frame(spark, data)
    run = lambda d: sorted(map(tuple, mixing.mix(d).select("doc_id", "source", "mix_size", "mix_source_size", "mix_target", "mix_taken").collect()), key=str)
    got = run(df)
    want, taken = check_mix(data, got)
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(40, 0.01 * t)
    assert got == run(df.repartition(7))


def test_mix_odd_rows(spark):
    df = frame(spark)
    got = mixing.mix(df)
    assert [c for c in got.columns if not c.startswith("mix_")] == df.columns
    assert got.count() == df.count() and got.where("text IS NULL AND mix_taken <> 0").count() == 0
    assert got.where("mix_taken > 2 * mix_size").count() == 0
    assert mixing.mix(df.where("false")).count() == 0


@pytest.mark.parametrize(("total", "cap"), [(3.0, 3.0), (2.5, 2.5), (0.3, 2.0), (5.0, 4.0)])
def test_any_cap(spark, total, cap):
    rnd = random.Random(9)
    df = spark.createDataFrame([(i, prose(rnd, rnd.randint(1, 90)), "en", f"s{i % 3}", 0) for i in range(300)], SCHEMA)
    words = sum(len(WORD.findall(r.text)) for r in df.collect())
    mixed = mixing.mix(df, total=total, cap=cap).collect()
    assert all(r.mix_taken <= math.ceil(cap) * r.mix_size for r in mixed)
    assert abs(sum(r.mix_taken for r in mixed) - min(total, cap) * words) <= 48
    taken = Counter()
    for r in mixing.take(df, total=total, cap=cap).collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
    assert taken == Counter({r.doc_id: r.mix_taken for r in mixed if r.mix_taken})


def test_small_sources_get_their_share(spark):
    df = spark.createDataFrame([(i, " ".join("w" * (i % 60 + 1)), "en", f"{i:04}", 0) for i in range(600)], SCHEMA)
    for r in mixing.mix(df).collect():
        assert abs(r.mix_taken - r.mix_target) <= 0.5


def test_rows_alike_but_for_the_text(spark):
    rnd = random.Random(10)
    data = [(i // 8, prose(rnd, 40), "en", "s", 0) for i in range(400)] + [(7, "the same row", "en", "s", 0)] * 50
    runs = []
    for turn in range(3):
        rnd.shuffle(data)
        out = mixing.take(spark.createDataFrame(data, SCHEMA).repartition(turn + 2).withColumn("mix_runs", F.lit("clash")))
        assert out.columns[-1] == "mix_runs"
        runs.append(sorted(map(tuple, out.collect())))
    assert runs[0] == runs[1] == runs[2]
    assert mixing.mix(spark.createDataFrame(data, SCHEMA).withColumn("mix_size", F.lit("clash"))).columns.count("mix_size") == 1


def test_taken_texts(spark):
    data = big_corpus(random.Random(8), 60)
    df = spark.createDataFrame(data, SCHEMA)
    mixed = {r.doc_id: r for r in mixing.mix(df).collect()}
    out = mixing.take(df)
    assert out.columns == df.columns
    text, words = {i: t for i, t, *_ in data}, Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text) > 0
        words[r.doc_id] += len(WORD.findall(r.text))
        found = WORD.findall(text[r.doc_id])
        assert r.text == text[r.doc_id] or all(w in found for w in WORD.findall(r.text))
    assert words == Counter({i: r.mix_taken for i, r in mixed.items() if r.mix_taken})


# --- sharding ------------------------------------------------------------------------------


def check_shards(data, got, shards):
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == sorted(((i, size(t), zlib.crc32((t or "").encode())) for i, t, *_ in data), key=str)
    slots, total = defaultdict(list), Counter()
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    return [total[s] for s in range(shards)]


def test_sharding(spark):
    rnd = random.Random(2)
    data = [(i, prose(rnd, rnd.randint(1, 60)), "en", "s", 0) for i in range(1500)]
    data += [(5000 + i, data[3][1], "en", "s", 0) for i in range(40)]
    got = sharding.assign(frame(spark, data), 16).collect()
    sizes = check_shards(data, got, 16)
    assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 16 + 2 * max(r.size for r in got)
    homes = defaultdict(set)
    text = {i: t for i, t, *_ in data}
    for r in got:
        homes[text[r.doc_id]].add(r.shard)
    assert all(len(v) == 1 for t, v in homes.items() if t != data[3][1])
    assert sorted(map(tuple, got)) == sorted(map(tuple, sharding.assign(frame(spark, data).repartition(5), 16).collect()))


def test_sharding_splits_a_hot_text(spark):
    rnd = random.Random(3)
    data = [(i, "the same text again", "en", "s", 0) for i in range(1000)] + [(2000 + i, prose(rnd, 4), "en", "s", 0) for i in range(500)]
    sizes = check_shards(data, sharding.assign(spark.createDataFrame(data, SCHEMA), 8).collect(), 8)
    assert max(sizes) <= 1.1 * sum(sizes) / 8


def test_sharding_splits_a_hot_row(spark):
    data = [(1, "same text " * 45, "en", "s", 0)] * 1000 + [(i, f"other text {i} " * 35, "en", "s", 0) for i in range(1000)]
    df, runs = spark.createDataFrame(data, SCHEMA), []
    for parts in (2, 7):
        got = sharding.assign(df.repartition(parts), 16).collect()
        sizes = check_shards(data, got, 16)
        assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 16 + max(r.size for r in got)
        runs.append(sorted(map(tuple, got)))
    assert runs[0] == runs[1]


def test_slots_follow_the_key_at_any_size(spark, monkeypatch):
    rnd = random.Random(4)
    data = [(i, prose(rnd, 6), "en", "s", 0) for i in range(500)] + [(1000 + i, f"copy {i % 5}", "en", "s", 0) for i in range(500)]
    df = spark.createDataFrame(data, SCHEMA)
    want = sorted(map(tuple, sharding.assign(df, 4).collect()))
    monkeypatch.setattr(sharding, "ORDER_ROWS", 10)
    assert sorted(map(tuple, sharding.assign(df, 4).collect())) == want
    by = defaultdict(list)
    for _, _, crc, shard, slot in want:
        by[shard].append((slot, crc))
    changes = sum(a[1] != b[1] for v in by.values() for a, b in zip(sorted(v), sorted(v)[1:], strict=False))
    assert changes + 4 <= len({crc for _, _, crc, _, _ in want}) + 3


def test_sharding_odd_rows(spark):
    df = frame(spark)
    check_shards(odd_documents(), sharding.assign(df, 4).collect(), 4)
    check_shards([(None, None)] * 9, sharding.assign(spark.createDataFrame([(None, None)] * 9, "doc_id long, text string"), 4).collect(), 4)
    assert sharding.assign(df.where("false"), 4).count() == 0
    assert {r.shard for r in sharding.assign(df, 1).collect()} == {0}


# --- SimHash -------------------------------------------------------------------------------


def plain_print(text, width=4):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, radius=4):
    """node -> smallest node; prints: node -> fingerprint."""
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    nodes = sorted(prints)
    values = np.array([prints[i] for i in nodes], np.uint64)
    for k, i in enumerate(nodes):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius):
            a, b = root(i), root(nodes[k + 1 + j])
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in nodes}


def near(rnd, value, flips):
    for b in rnd.sample(range(64), flips):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_near_pairs(radius):
    rnd = random.Random(radius)
    keys, values = [], []
    for group in range(30):
        center = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 3, 64, 65, 150])):
            keys.append(group)
            values.append(near(rnd, center, rnd.randint(0, 9)))
    keys, values = np.array(keys), np.array(values, np.uint64)
    got = {(int(i), int(j)) for a, b in simhash.near_pairs(keys, values, radius, at_once=500) for i, j in zip(a, b, strict=True)}
    want = {(i, j) for i in range(len(keys)) for j in range(i + 1, len(keys)) if keys[i] == keys[j] and int(values[i] ^ values[j]).bit_count() <= radius}
    assert got == want


def test_masks_cover_every_pair():
    rnd = random.Random(1)
    for count in (10, 10**7, 10**10):
        masks = simhash.bucket_masks(count, 4)
        for _ in range(2000):
            a = rnd.getrandbits(64)
            b = near(rnd, a, rnd.randint(0, 4))
            assert any((a ^ b) & m == 0 for m in masks)
    assert len(simhash.bucket_masks(10**10, 4)) > 5


def test_links_and_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK_ROWS", 16)  # so that buckets are split
    rnd = random.Random(12)
    values = {rnd.getrandbits(64) for _ in range(60)}
    for center in list(values)[:6]:
        values |= {near(rnd, center, rnd.randint(1, 3)) for _ in range(60)}
        chain = center
        for _ in range(12):
            chain = near(rnd, chain, 4)
            values.add(chain)
    prints = dict(enumerate(sorted(values)))
    nodes = spark.createDataFrame([(simhash.signed(v), i) for i, v in prints.items()], "fp long, node long")
    edges = simhash.links(nodes)
    assert edges.count() <= 5 * 40 * len(prints)
    roots = {r.node: r.root for r in simhash.connected(edges).collect()}
    assert {i: roots.get(i, i) for i in prints} == plain_components(prints)


def test_connected_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(5, 5), (1000, 1001), (1001, 1000)], "a long, b long")
    assert rows(simhash.connected(edges)) == [(i, 0) for i in range(1, 301)] + [(1001, 1000)]
    assert simhash.connected(edges.where("false")).count() == 0


def near_copies(rnd):
    data = []
    for g in range(12):
        base = prose(rnd, 500).split()
        for c in range(rnd.choice([1, 2, 6])):
            words = list(base)
            for _ in range(c):
                words[rnd.randrange(len(words))] = "changed"
            data.append((g * 100 + c, " ".join(words), "en", "s", 1))
    return data


def test_groups(spark):
    data = odd_documents() + near_copies(random.Random(3))
    df = frame(spark, data)
    got = simhash.groups(df).collect()
    known = {plain_print(t) for i, t, *_ in data if i is not None}
    roots, smallest = plain_components({p: p for p in known}), {}
    for i, t, *_ in data:
        if i is not None:
            root = roots[plain_print(t)]
            smallest[root] = min(i, smallest.get(root, i))
    want = sorted((i, f"{plain_print(t):016x}", smallest[roots[plain_print(t)]]) for i, t, *_ in data if i is not None)
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == want
    assert sum(r.doc_id is None for r in got) == 2
    assert simhash.groups(df.where("false")).count() == 0


def plain_similar(data, width=5, similarity=0.8):
    """id -> smallest id over Jaccard links; data: rows with ids."""
    sets, keys = {}, {}
    for i, t, *_ in data:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[i] = {tuple(words)} if len(words) < width else {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        keys[i] = tuple(words)
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            shared = len(sets[i] & sets[j])
            if keys[i] == keys[j] or (keys[i] and keys[j] and shared >= similarity * len(sets[i] | sets[j])):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def edited_copies(rnd, n=25):
    data = []
    for g in range(n):
        base = prose(rnd, rnd.choice([30, 120, 500])).split()
        for c in range(rnd.choice([1, 2, 8])):
            words = list(base)
            for _ in range(rnd.randint(0, max(1, len(words) // 60)) if c else 0):
                words[rnd.randrange(len(words))] = "changed"
            data.append((1000 + g * 100 + c, " ".join(words), "en", "s", 1))
    return data


def test_similar_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FAMILY_ROWS", 3)  # so that families are split
    data = [r for r in odd_documents() if r[0] is not None] + edited_copies(random.Random(3))
    got = {(r.id, r.component_id) for r in neardup.groups(frame(spark, data)).collect()}
    want = plain_similar(data)
    assert got == set(want.items())
    assert len(set(want.values())) < len(want) - 15
    assert neardup.groups(frame(spark).where("false")).count() == 0


def found_share(pairs):
    """Share of the pairs of texts that lie within the radius in one of the fingerprints."""
    near = 0
    for a, b in pairs:
        x, y = neardup.split_words(a), neardup.split_words(b)
        sims = [(neardup.simhash(neardup.hashes(x, n)) ^ neardup.simhash(neardup.hashes(y, n))).bit_count() for n in (1, 2, 5)]
        near += min(sims) <= neardup.RADIUS and sims[2] <= neardup.SHINGLE_RADIUS
    return near / len(pairs)


def similarity(a, b):
    x, y = (set(neardup.hashes(neardup.split_words(t), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_of_candidates():
    rnd, edits, blocks = random.Random(11), [], []
    while len(edits) < 150 or len(blocks) < 150:
        base = prose(rnd, rnd.choice([60, 150, 400])).split()
        words = list(base)
        for _ in range(max(1, len(words) // 60)):
            words[rnd.randrange(len(words))] = rnd.choice(["changed", "edited", "new"])
        at, block = rnd.randrange(len(base)), prose(rnd, max(1, len(base) // 12)).split()
        for kept, other in ((edits, words), (blocks, base[:at] + block + base[at:])):
            pair = " ".join(base), " ".join(other)
            if similarity(*pair) >= 0.8:
                kept.append(pair)
    assert found_share(edits) >= 0.97
    assert found_share(blocks) >= 0.75  # a new passage of a twelfth of the text


def test_passage_edits_are_linked(spark):
    rnd, data = random.Random(17), []
    while len(data) < 400:
        base = prose(rnd, rnd.choice([60, 150, 400, 1500])).split()
        n = max(1, int(len(base) * rnd.uniform(0.05, 0.2)))
        at, block = rnd.randrange(len(base) - n), prose(rnd, n).split()
        other = rnd.choice([base[:at] + block + base[at:], base[:at] + base[at + n :], base[:at] + block + base[at + n :]])
        pair = " ".join(base), " ".join(other)
        if 0.8 <= similarity(*pair) < 0.85:
            data += [(len(data) + i, t) for i, t in enumerate(pair)]
    roots = {r.id: r.component_id for r in neardup.groups(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert sum(roots[i] == roots[i + 1] for i in range(0, 400, 2)) >= 0.99 * 200


def test_keep_one(spark):
    data = odd_documents() + edited_copies(random.Random(4))
    df = frame(spark, data)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids) == sorted(set(plain_similar([r for r in data if r[0] is not None]).values()))
    alone = spark.createDataFrame([(None, "a b c d e f"), (None, "A b c d e f"), (None, None)], "doc_id long, text string")
    assert neardup.keep_one(alone).count() == 2


def test_keep_one_where_ids_do_not_name_texts(spark):
    rnd = random.Random(6)
    a, b, c, d = (prose(rnd, 200) for _ in range(4))
    data = [(7, a), (7, b), (7, a), (9, b + " more"), (3, c), (5, c + " more"), (5, a + " more"), (None, d), (None, d + " more"), (None, d), (None, c + " again"), (None, None)]
    kept = sorted(((r.doc_id, r.text) for r in neardup.keep_one(spark.createDataFrame(data, "doc_id long, text string")).collect()), key=str)
    first = next(t for i, t in kept if i is None and t)
    assert first in (d, d + " more")
    assert kept == sorted([(5, a + " more"), (7, b), (3, c), (None, first), (None, None)], key=str)


# --- top-k -----------------------------------------------------------------------------------


def plain_top(vectors, k=5):
    ints = [(i, [math.floor(256.0 * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(256.0 * x) for x in v)]
    out, most = [], (1 << 63) - 1
    for row, (q, a) in enumerate(ints):
        if q is not None and q % 50 == 0:
            scores = [(max(-most - 1, min(most, sum(x * y for x, y in zip(a, b, strict=True)))), i) for n, (i, b) in enumerate(ints) if n != row and len(a) == len(b)]
            scores.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out, key=str)


def odd_vectors(rnd):
    f32 = lambda x: float(np.float32(x))
    vectors = [(i, [f32(rnd.gauss(0, 0.2)) for _ in range(8)]) for i in range(400)]
    vectors += [(1000 + i, [0.5] * 8) for i in range(100)]  # ties
    vectors += [(2000, None), (2050, [None] * 8), (2100, [float("nan")] * 8), (2150, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (None, [1.0] * 8), (3000, [1.0, -1.0]), (3001, [0.5, 0.25]), (3050, []), (3051, [])]
    big = [f32(1e30), f32(-1e30), f32(3e38), 1.0, 2.0, 0.25]
    vectors += [(4000 + 10 * i, [rnd.choice(big), rnd.choice(big), rnd.choice(big)]) for i in range(40)]
    return vectors + [vectors[50], vectors[51], vectors[50], (50, [0.1] * 8)]


@pytest.mark.parametrize("small", [True, False])
def test_top_k(spark, monkeypatch, small):
    if small:
        for name, value in (("GROUP_ROWS", 40), ("QUERY_ROWS", 3), ("BOUND_ROWS", 2), ("PIVOTS", 5), ("BLOCK_ROWS", 16)):
            monkeypatch.setattr(topk, name, value)
    vectors = odd_vectors(random.Random(5))
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors], "vec_id long, embedding array<float>, label int, rank string")
    assert sorted(map(tuple, topk.top_k(df, "vec_id % 50 = 0").collect()), key=str) == plain_top(vectors)
    assert topk.top_k(df.where("false"), "vec_id % 50 = 0").count() == 0


def test_queries_skip_ranges_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 400, (32, 16))
    data = np.concatenate([rng.normal(c, 4, (256, 16)) for c in centers]).round()
    numbers = np.arange(len(data))
    best, scored = topk.search(numbers.tolist(), numbers, data, numbers[::64], data[::64], 5)
    scores = (data[::64] @ data.T).astype(np.int64)
    for i, q in enumerate(numbers[::64]):
        want = sorted((-int(s), int(j)) for j, s in enumerate(scores[i]) if j != q)[:5]
        assert best[i] == [(-s, j, j) for s, j in want]
    assert scored < 0.5 * len(best) * len(data) / topk.BLOCK_ROWS
    floor = np.array([b[-1][0] for b in best], float)
    again, fewer = topk.search(numbers.tolist(), numbers, data, numbers[::64], data[::64], 5, floor)
    assert again == best and fewer <= scored

    written = {}
    keep = topk.materialize
    monkeypatch.setattr(topk, "GROUP_ROWS", 256)
    monkeypatch.setattr(topk, "materialize", lambda df, label: written.setdefault(label, keep(df, label)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    assert topk.top_k(df, "vec_id % 50 = 0", scale=1).count() == 5 * 164
    assert written["sent"].count() < 0.5 * 164 * written["extremes"].count()


def test_large_components_stay_exact():
    data = np.array([[1 << 30, 3], [(1 << 30) - 1, 3], [5, 7]], np.int64)
    best, _ = topk.search([0, 1, 2], np.arange(3), data.astype(float), np.array([9]), data[:1].astype(float), 3)
    assert best[0] == [((1 << 60) + 9, 0, 0), ((1 << 60) - (1 << 30) + 9, 1, 1), (5 * (1 << 30) + 21, 2, 2)]
