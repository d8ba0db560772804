import random

import pytest

from lexigrid.llm import bpe, tokencount

from .helpers import frame, odd_documents, rows

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ours():
    return bpe.encoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(ours):
    import tiktoken

    return tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ours.vocab.ranks, special_tokens={})


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    alphabet = "abcdefgh tion'sve ABCÉéßΣσςİıﬁΩ你好世界 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u3000\u180e12٣ⅷ½!?.,-___'́̇😀👩‍👧<|>endoftext"
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_equals_library(ours, library):
    for text in odd_texts(3000) + [t or "" for _, t, *_ in odd_documents()]:
        ids = ours.encode(text)
        assert ids == library.encode_ordinary(text)
        assert ours.decode(ids) == text.encode()


def test_edits_and_appends_are_exact(ours):
    rnd = random.Random(2)
    for _ in range(60):
        piece = "".join(rnd.choice("abcdeinthr ") for _ in range(150)).encode()
        table = bpe.PrefixEncoder(ours.vocab, piece[:70])
        table.append(piece[70:])
        assert table.encode() == ours.vocab.merge(piece)
        a = rnd.randint(0, 149)
        b = min(150, a + rnd.randint(0, 5))
        table.edit(a, b, b"xthe"[: rnd.randint(0, 4)])
        assert table.encode() == ours.vocab.merge(table.piece)


def test_edit_redoes_the_neighbourhood_only(ours):
    words = (b"the quick brown fox and " * 2000)[:40000]
    table = bpe.PrefixEncoder(ours.vocab, words)
    assert table.edit(100, 101, b"z") < 1000
    assert table.encode() == bpe.PrefixEncoder(ours.vocab, table.piece).encode()


def test_operator(spark, library):
    df = frame(spark)
    found = bpe.encode_decode(df, PATH, P.PATTERN)
    assert found.columns == ["doc_id", "ids", "decoded"]
    want = sorted(((i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in odd_documents()), key=str)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in found.collect()), key=str) == want
    assert bpe.encode_decode(df.where("false"), PATH, P.PATTERN).count() == 0


def test_token_counts(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library, ours = Tokenizer.from_file(path), tokencount.counter(path)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    rnd = random.Random(3)
    for i, text in enumerate(odd_texts(2000, 4)):
        text = text + "<|endoftext|>" + text[:7] + "<|startoftext|>" if i % 5 == 0 else text
        assert ours.tokens(text, rnd.choice([1, 2, 5, 64])) == count(text), repr(text)
    found = tokencount.count_tokens(frame(spark), path)
    assert rows(found) == rows(spark.createDataFrame([(i, len((t or "").encode()), count(t or "")) for i, t, *_ in odd_documents()], "doc_id long, n_bytes long, n_tokens long"))
    assert tokencount.count_tokens(frame(spark).where("false"), path).count() == 0


def test_chunk_maps_compose_in_any_grouping():
    ours, rnd = tokencount.counter(P.path("word_bpe_49k.json")), random.Random(6)
    machine, pieces = ours.machine, ["it's", "'re", "''s", "'", "r'e", "'ll", "'l", "x9'tz", "unbroken" * 30, "!'s", "né", "日本", "😀'd", " ", "  ", "'v", "e", "42"]
    for _ in range(150):
        text = ours.normal("".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 40))))
        cuts = sorted(rnd.randint(0, len(text)) for _ in range(rnd.randint(0, 12)))
        machine.read = 0
        maps = [ours.chunk(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        left = maps[0]
        for m in maps[1:]:
            left = machine.compose(left, m)
        total = machine.total(left)
        assert total == ours.count(text), repr(text)
        assert machine.read <= len(text)  # no character is read twice
        right = maps[-1]
        for m in reversed(maps[:-1]):
            right = machine.compose(m, right)
        assert machine.total(right) == machine.total(machine.scan(maps)) == total


def test_a_map_acts_on_every_state():
    ours = tokencount.counter(P.path("word_bpe_49k.json"))
    machine = ours.machine
    for before in ("", "wor", "'", "'l", "'re", "!?", "9", "it'", "caf"):
        state, emitted = machine.run((tokencount.IDLE, 0), before)
        for chunk in ("ds and more", "l", "é's x'", "", " ", "''"):
            found = ours.chunk(chunk)
            after, more = machine.run(state, found.head)
            got = emitted + more + machine.close(after) + (0 if found.tokens is None else found.tokens + machine.close(found.out))
            assert got == ours.count(before + chunk), (before, chunk)


def test_no_special_strings(tmp_path):
    import json

    spec = json.load(open(P.path("word_bpe_49k.json"), encoding="utf-8"))
    spec["added_tokens"] = []
    (tmp_path / "t.json").write_text(json.dumps(spec), encoding="utf-8")
    assert tokencount.TokenCounter(str(tmp_path / "t.json")).tokens("two words") == tokencount.counter(P.path("word_bpe_49k.json")).tokens("two words")
