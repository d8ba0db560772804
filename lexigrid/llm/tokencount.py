"""Token counts by a compiled finite-state tokenizer.

The merges of a word-level BPE become a deterministic transducer over byte symbols. Its
states are word prefixes; a transition is annotated with the number of tokens by which
the encoding of the prefix grows, and a final weight closes a word. States are compiled
when they are first reached and kept in a bounded table.

The split pattern is a small machine around it, over characters: nothing pending, letters or
other characters pending (with their transducer state), or the beginning of a contraction.
A chunk of text is a map from the machine's states to states and token counts: white space
resets the machine whatever state it is in, so the map reads the characters before the first
blank from the given state, then has a fixed count and a fixed state to go on in. Maps
compose associatively, and the composition reads just those characters, from the state of
the chunk before; a long text is the tree-wise composition of its chunks.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memory, arrow_map

#: Characters of a chunk; states and words that a worker keeps compiled.
CHUNK, STATES, WORDS, PAIRS = 1 << 15, 1 << 19, 1 << 18, 1 << 19
END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable
    Latin-1, else the next free character from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class WordBpe:
    """Merges of a BPE whose last symbol of a word carries a mark."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.vocab = vocab
        self.rank = {tuple(pair): i for i, pair in enumerate(merges)}
        #: Trie over reversed tokens; "" and END lead to the inner and the final token there.
        self.ends: dict = {}
        for token in vocab:
            end = END if token.endswith(END) and len(token) > len(END) else ""
            node = self.ends
            for symbol in reversed(token[: len(token) - len(end)]):
                node = node.setdefault(symbol, {})
            node["" if not end else END] = token
        self.made = {a + b: i for i, (a, b) in enumerate(merges)}
        self.halves = {a + b: (a, b) for a, b in merges}
        if len(self.made) < len(merges):
            raise ValueError("each token is expected to have one merge")
        self._stable: dict[tuple[str, str], bool] = {}
        self._whole: dict[str, bool] = {}

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and len(token) > len(END):
            body = token[: -len(END)]
            return [*body[:-1], body[-1] + END]
        return list(token)

    def merge(self, parts: list[str]) -> list[str]:
        """The encoding by definition; quadratic, used on pairs of tokens."""
        parts = list(parts)
        while len(parts) > 1:
            rank, i = min((self.rank.get((parts[i], parts[i + 1]), 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def whole(self, token: str) -> bool:
        known = self._whole.get(token)
        if known is None:
            known = self._whole[token] = self.merge(self.symbols(token)) == [token]
        return known

    def stable(self, left: str, right: str) -> bool:
        """Do the two tokens stay two when their symbols are merged from scratch?

        Merges are undone along the border, the latest first; a border pair would have been
        joined if its rank is lower than that of the merge that took away its left member,
        and not higher than that of the one that took away its right member.
        """
        known = self._stable.get((left, right))
        if known is None:
            if len(self._stable) >= PAIRS:
                self._stable.clear()
            known = self._stable[left, right] = self._apart(left, right)
        return known

    def _apart(self, x: str, y: str) -> bool:
        never = 1 << 60
        x_gone = y_gone = never
        while True:
            joined = self.rank.get((x, y), never)
            if joined < x_gone and joined <= y_gone and joined < never:
                return False
            x_made, y_made = self.made.get(x, -1), self.made.get(y, -1)
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                x_gone, x = x_made, self.halves[x][1]
            else:
                y_gone, y = y_made, self.halves[y][0]


class WordTransducer:
    """Lazily compiled. State 0 starts a word; any other state is a prefix whose last
    symbol is pending, as it may turn out to end the word. A state keeps its last symbol, the
    state before it, and the last token and the token count of its prefix without the
    pending symbol; the transition into it is annotated with the growth of that count."""

    def __init__(self, bpe: WordBpe):
        self.bpe = bpe
        self.reset()

    def reset(self) -> None:
        self.arrows: dict[int, int] = {}
        self.parent: list[int] = [0]
        self.symbol: list[str] = [""]
        self.last: list[str] = [""]
        self.count: list[int] = [0]
        self.weight: list[int] = [0]
        self.final: dict[int, int] = {}

    def _close(self, state: int, mark: str) -> tuple[str, int]:
        """Last token and token count of the state's prefix, its last symbol taken as inner
        (mark "") or as the end of the word. Walks back at most a token's length."""
        bpe, known, node, at = self.bpe, self.bpe._stable, self.bpe.ends, state
        while at:
            node = node.get(self.symbol[at])
            if node is None:
                break
            token, before = node.get(mark), self.parent[at]
            if token is not None and not before:
                if bpe.whole(token):
                    return token, 1
            elif token is not None:
                pair = self.last[at], token
                fits = known.get(pair)
                if fits is None:
                    fits = bpe.whole(token) and bpe.stable(*pair)
                if fits:
                    return token, self.count[at] + 1
            at = before
        raise ValueError("the vocabulary lacks a symbol")

    def step(self, at: int, symbol: str) -> int:
        """The state behind one more symbol; weight[...] of it are the tokens emitted."""
        key = at << 10 | ord(symbol)
        to = self.arrows.get(key)
        if to is None:
            to = self.arrows[key] = len(self.last)
            token, count = self._close(at, "") if at else ("", 0)
            self.parent.append(at)
            self.symbol.append(symbol)
            self.last.append(token)
            self.count.append(count)
            self.weight.append(count - self.count[at])
        return to

    def closing(self, at: int) -> int:
        """Tokens emitted where the word ends in this state."""
        found = self.final.get(at)
        if found is None:
            found = self.final[at] = self._close(at, END)[1] - self.count[at]
        return found

    def run(self, symbols: str) -> int:
        """Tokens of one word: the weights along its path and the final weight."""
        if len(self.last) > STATES:
            self.reset()
        arrows, weight, at, total = self.arrows, self.weight, 0, 0
        for symbol in symbols:
            to = arrows.get(at << 10 | ord(symbol))
            at = self.step(at, symbol) if to is None else to
            total += weight[at]
        return total + self.closing(at)


#: What is pending in the machine: nothing, letters, other characters, or the beginning of a
#: contraction behind nothing pending (an apostrophe, or it and a letter).
IDLE, LETTERS, OTHER, APOSTROPHE = "", "letters", "other", "'"
#: Contractions that are words of their own.
SHORT, LONG = "stmd", {"'r": "e", "'v": "e", "'l": "l"}
State = tuple[str, int]


class ChunkMap(NamedTuple):
    """From any state: read `head`; then (tokens is not None) the machine is reset, `tokens`
    are emitted and it goes on in the state `out`."""

    head: str
    tokens: int | None
    out: State


class Machine:
    """The split pattern and the word transducer as one machine over characters."""

    def __init__(self, bpe: WordBpe, table: dict):
        import regex

        self.words, self.table, self.read = WordTransducer(bpe), table, 0
        self.is_letter, self.is_number = regex.compile(r"\p{L}").match, regex.compile(r"\p{N}").match

    def _add(self, node: int, char: str) -> tuple[int, int]:
        emitted = 0
        for symbol in char.encode().decode("latin-1").translate(self.table):
            node = self.words.step(node, symbol)
            emitted += self.words.weight[node]
        return node, emitted

    def word(self, text: str) -> int:
        node, emitted = 0, 0
        for char in text:
            node, more = self._add(node, char)
            emitted += more
        return emitted + self.words.closing(node)

    def close(self, state: State) -> int:
        """Tokens emitted where the state's pending characters end."""
        mode, node = state
        if mode in LONG:
            return self.word("'") + self.word(mode[1])
        return 0 if mode == IDLE else self.words.closing(node)

    def step(self, state: State, char: str) -> tuple[State, int]:
        """The state behind one character that is no blank, and the tokens emitted."""
        mode, node = state
        letter, number = self.is_letter(char), self.is_number(char)
        emitted = 0
        if mode == APOSTROPHE:
            if char in SHORT:
                return (IDLE, 0), self.word("'" + char) - self.words.weight[node]
            if "'" + char in LONG:
                return ("'" + char, node), -self.words.weight[node]
            if not letter and not number:
                mode = OTHER
        elif mode in LONG:
            if char == LONG[mode]:
                return (IDLE, 0), self.word(mode + char)
            # no contraction: the apostrophe was a word, its letter begins one
            emitted, (node, more) = self.word("'"), self._add(0, mode[1])
            mode, emitted = LETTERS, emitted + more
        going = letter if mode == LETTERS else mode == OTHER and not letter and not number
        if not going:
            emitted, node = emitted + self.close((mode, node)), 0
            if number:
                return (IDLE, 0), emitted + self.word(char)
            mode = LETTERS if letter else APOSTROPHE if char == "'" else OTHER
        node, more = self._add(node, char)
        return (mode, node), emitted + more

    def run(self, state: State, text: str) -> tuple[State, int]:
        emitted, self.read = 0, self.read + len(text)
        for char in text:
            state, more = self.step(state, char)
            emitted += more
        return state, emitted

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if a.tokens is None:
            return ChunkMap(a.head + b.head, b.tokens, b.out)
        state, emitted = self.run(a.out, b.head)
        if b.tokens is None:
            return ChunkMap(a.head, a.tokens + emitted, state)
        return ChunkMap(a.head, a.tokens + emitted + self.close(state) + b.tokens, b.out)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Composition of all maps, neighbours first (the up-sweep of a prefix scan)."""
        while len(maps) > 1:
            paired = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = paired + maps[len(maps) - len(maps) % 2 :]
        return maps[0]

    def total(self, whole: ChunkMap) -> int:
        """Tokens of a text that is this map."""
        state, emitted = self.run((IDLE, 0), whole.head)
        emitted += self.close(state)
        return emitted if whole.tokens is None else emitted + whole.tokens + self.close(whole.out)


class TokenCounter:
    """Counts what the library's tokenizer file gives: special strings, normalisation, the
    split pattern, then words."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != END:
            raise ValueError("a BPE with word ends is expected")
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.transducer = WordTransducer(WordBpe(model["vocab"], merges))
        self.find = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.blank = regex.compile(spec["normalizer"]["normalizers"][1]["pattern"]["Regex"])
        special = sorted((x["content"] for x in spec["added_tokens"] if x["content"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.table = str.maketrans({chr(b): symbol for b, symbol in enumerate(byte_symbols())})
        self.words = Memory(self.word, WORDS, 48)
        self.machine = Machine(self.transducer.bpe, self.table)

    def word(self, word: str) -> int:
        return self.transducer.run(word.encode().decode("latin-1").translate(self.table))

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # lower case letter by letter: no rule for a sigma that ends a word
        return self.blank.sub(" ", text).replace("Σ", "σ").lower()

    def count(self, text: str) -> int:
        return sum(map(self.words.__getitem__, self.find(text)))

    def chunk(self, text: str) -> ChunkMap:
        """The map of a chunk; whole words between blanks are counted by the word."""
        first = text.find(" ")
        if first < 0:
            return ChunkMap(text, None, (IDLE, 0))
        final = text.rfind(" ")
        state, emitted = self.machine.run((IDLE, 0), text[final + 1 :])
        return ChunkMap(text[:first], self.count(text[first:final]) + emitted, state)

    def tokens(self, text: str, chunk: int = CHUNK) -> int:
        total = 0
        for i, part in enumerate(self.special.split(text)):
            total += i > 0  # the special string before this part is one token
            part = self.normal(part)
            if len(part) <= chunk:
                total += self.count(part)
                continue
            total += self.machine.total(self.machine.scan([self.chunk(part[k : k + chunk]) for k in range(0, len(part), chunk)]))
            if len(self.machine.words.last) > STATES:
                self.machine.words.reset()
        return total


@lru_cache(maxsize=4)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def count_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_bytes long (UTF-8), n_tokens long, by the tokenizer file at `path`.

    A null text is empty (0, 0); repeated rows are kept one by one; a very long text is
    counted in chunks; other columns are not read. One scan without a shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        by = counter(path)
        texts = [x or "" for x in batch.column(1).to_pylist()]
        sizes = pa.array([len(x.encode()) for x in texts], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array([by.tokens(x) for x in texts], pa.int64())], ["id", "n_bytes", "n_tokens"])

    found = arrow_map(df, [df[id_col].alias("id"), df[text_col].alias("text")], f"id {kind}, n_bytes long, n_tokens long", per_slice)
    return found.withColumnRenamed("id", id_col)
