"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For a piece of bytes b[0:n] the table `last` holds, for every prefix, the one token that
ends the BPE encoding of that prefix. A token t that is a suffix of b[:i] is that token
exactly if the pair (last[i - len(t)], t) is stable, i.e. if merging the bytes of the two
tokens from scratch gives these two tokens again. Prefixes therefore extend without
looking back: appends are exact, and after an edit only the neighbourhood is redone.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memory, arrow_map

#: Encoded pieces that a worker remembers, and the longest piece it remembers.
CACHED_PIECES, CACHED_CHARS, CACHED_PAIRS, TRIE_NODES = 1 << 17, 48, 1 << 18, 1 << 18

TOKEN = 256


class ByteVocab:
    """Ranks of a byte-level BPE; an id is the rank of its token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        #: Trie over the reversed tokens; TOKEN leads to the id of the token that begins there.
        self.ends: dict = {}
        for token, rank in ranks.items():
            node = self.ends
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[TOKEN] = rank
        self._stable: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    @classmethod
    def load(cls, path: str) -> ByteVocab:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def merge(self, piece: bytes, below: int = 1 << 60) -> list[int]:
        """Encoding by definition: join the adjacent pair of lowest rank (under `below`),
        leftmost first, until none is left. Quadratic; used on single tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            found = [(self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1)]
            rank, i = min(found)
            if rank >= below:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[part] for part in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte, and for a token
        that merging its bytes doesn't give."""
        if token not in self._halves:
            data = self.tokens[token]
            parts = self.merge(data, token) if len(data) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def whole(self, token: int) -> bool:
        """Do the bytes of this token merge to the token itself?"""
        return len(self.tokens[token]) == 1 or self.halves(token) is not None

    def stable(self, left: int, right: int) -> bool:
        """Do the two tokens stay two when their bytes are merged from scratch?

        The merges are undone, the latest first, only along the border. A border pair would
        have been joined if its rank is lower than that of the merge that took away its
        left member (which goes first at the same rank), and not higher than that of the one
        that took away its right member.
        """
        known = self._stable.get(left << 32 | right)
        if known is None:
            if len(self._stable) >= CACHED_PAIRS:
                self._stable.clear()
            known = self._stable[left << 32 | right] = self._apart(left, right)
        return known

    def _apart(self, x: int, y: int) -> bool:
        ranks, tokens, never = self.ranks, self.tokens, 1 << 60
        x_gone = y_gone = never
        while True:
            joined = ranks.get(tokens[x] + tokens[y], never)
            if joined < x_gone and joined <= y_gone and joined < never:
                return False
            x_made, y_made = x if len(tokens[x]) > 1 else -1, y if len(tokens[y]) > 1 else -1
            if x_made < 0 and y_made < 0:
                return True
            if x_made > y_made:
                x_gone, x = x, self.halves(x)[1]
            else:
                y_gone, y = y, self.halves(y)[0]


def last_token(vocab: ByteVocab, piece: bytes, end: int, last: list[int]) -> int:
    """The one token that ends the encoding of piece[:end]; last[i] ends that of
    piece[: i + 1], for all shorter prefixes."""
    node, known, at = vocab.ends, vocab._stable, end
    while at:
        at -= 1
        node = node.get(piece[at])
        if node is None:
            break
        token = node.get(TOKEN)
        if token is None:
            continue
        if not at:
            if vocab.whole(token):
                return token
            continue
        pair = last[at - 1] << 32 | token
        fits = known.get(pair)
        if fits is None:
            fits = vocab.whole(token) and vocab.stable(last[at - 1], token)
        if fits:
            return token
    raise ValueError("the vocabulary lacks a byte")


def trace(vocab: ByteVocab, last: list[int]) -> list[int]:
    """The encoding of a piece from its prefix table, from the end."""
    found, end = [], len(last)
    while end:
        token = last[end - 1]
        found.append(token)
        end -= len(vocab.tokens[token])
    return found[::-1]


class PrefixTrie:
    """Prefix tables of many pieces at once: pieces that begin alike share their entries.
    Starts anew at TRIE_NODES entries."""

    def __init__(self, vocab: ByteVocab):
        self.vocab, self.steps, self.last = vocab, {}, [-1]

    def encode(self, piece: bytes) -> list[int]:
        if len(self.last) > TRIE_NODES:
            self.steps, self.last = {}, [-1]
        steps, at, path = self.steps, 0, []
        for end, byte in enumerate(piece, 1):
            key = at << 8 | byte
            to = steps.get(key)
            if to is None:
                to = steps[key] = len(self.last)
                self.last.append(last_token(self.vocab, piece, end, path))
            at = to
            path.append(self.last[to])
        return trace(self.vocab, path)


class PrefixEncoder:
    """The prefix table of one piece: append, edit and encode it."""

    def __init__(self, vocab: ByteVocab, piece: bytes = b""):
        self.vocab, self.piece, self.last = vocab, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        start = len(self.piece)
        self.piece += more
        for end in range(start + 1, len(self.piece) + 1):
            self.last.append(last_token(self.vocab, self.piece, end, self.last))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replace piece[start:stop]; returns the number of prefixes that were redone.

        The table is kept before the edit. Behind it, work stops as soon as the last
        tokens of as many prefixes in a row as a token can be long are what they were.
        """
        old_last, shift = self.last, len(new) - (stop - start)
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last = old_last[:start]
        longest, same, done = max(map(len, self.vocab.ranks)), 0, 0
        for end in range(start + 1, len(self.piece) + 1):
            token = last_token(self.vocab, self.piece, end, self.last)
            self.last.append(token)
            done += 1
            behind = end > start + len(new)
            same = same + 1 if behind and old_last[end - shift - 1] == token else 0
            if same >= longest:
                self.last += old_last[end - shift :]
                break
        return done

    def encode(self) -> list[int]:
        return trace(self.vocab, self.last)


class ByteBpe:
    """Encoder and decoder of whole texts: the pattern splits, each match is a piece."""

    def __init__(self, vocab: ByteVocab, pattern: str):
        import regex

        self.vocab, self.find = vocab, regex.compile(pattern).findall
        self.pieces, self.trie = Memory(self.piece, CACHED_PIECES, CACHED_CHARS), PrefixTrie(vocab)

    def piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.vocab.ranks.get(data)  # a piece that is a token stays one
        if whole is not None:
            return (whole,)
        return tuple(self.trie.encode(data) if len(data) <= 2 * CACHED_CHARS else PrefixEncoder(self.vocab, data).encode())

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for more in map(self.pieces.__getitem__, self.find(text)):
            ids += more
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocab.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(ByteVocab.load(path), pattern)


def encode_decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """`id_col`, ids array<int>, decoded binary (the bytes that the ids stand for; null
    without `decode`).

    path: a rank file that every executor has (a parameter; a file of an installed
    package). A null text is empty and gives no ids; rows, ties and repeated rows are
    kept one by one, a very long text is encoded whole; columns besides the two are not
    read. No shuffle: one scan.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def per_slice(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = encoder(path, pattern)
        values, ends, decoded = [], [0], []
        for text in batch.column(1).to_pylist():
            ids = bpe.encode(text or "")
            values.append(np.array(ids, dtype=np.int32))
            ends.append(ends[-1] + len(ids))
            decoded.append(bpe.decode(ids) if decode else None)
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

    found = arrow_map(df, [df[id_col].alias("id"), df[text_col].alias("text")], f"id {kind}, ids array<int>, decoded binary", per_slice, rows=256)
    return found.withColumnRenamed("id", id_col)
