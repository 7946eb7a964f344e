"""Encoding a corpus by a byte-level BPE vocabulary (problem 8).

The merges are compiled into a finite-state transducer over bytes that is determinised lazily. The encoding of every
prefix of a word is unique, so the last token of each prefix follows from the last tokens of shorter ones: a token
may end here if it may stand behind the last token at its start, i.e. if no merge across their boundary comes before
the merges that built them. A state holds the bytes that may still belong to an open token and, for each boundary
within them, the tokens since the last settled boundary; tokens on which all open boundaries agree are emitted, at
the latest after as many bytes as the longest token has. States and arcs are made when first met and kept, so
words that share a prefix share its states. Decoding streams through an incremental UTF-8 state machine.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folder of the vocabulary files; every call takes another one.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: how text is split before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ids of a rank file: one base64 token and its id a line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Byte-level BPE as a lazily determinised transducer; ids are in order of their merges."""

    def __init__(self, ranks: dict[bytes, int], most_states: int = 200_000, most_words: int = 200_000):
        self.ranks, self.most_states, self.most_words = ranks, most_states, most_words
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.heads = {t[:n] for t in ranks for n in range(1, len(t))}  # proper prefixes of tokens
        self.parts = self._split()
        self.pairs = {(a, b): t for t, (a, b) in self.parts.items() if a != t}
        self.valid: dict[tuple[int, int], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: open bytes, last settled token (-1: none), for each boundary in the open bytes the tokens since
        self.states: list[tuple[bytes, int, tuple]] = [(b"", -1, ((),))]
        self.index = {self.states[0]: 0}
        self.arcs: dict[tuple[int, int], tuple[int, tuple[int, ...]]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def _split(self) -> dict[int, tuple[int, int]]:
        """For each token the two tokens of its merge: the last merge of its own encoding by smaller ids alone."""
        parts = {}
        for token, i in self.ranks.items():
            if len(token) == 1:
                parts[i] = (i, i)
                continue
            pieces = [self.ranks[token[k : k + 1]] for k in range(len(token))]
            while len(pieces) > 2:
                best = None
                for k in range(len(pieces) - 1):
                    r = self.ranks.get(self.tokens[pieces[k]] + self.tokens[pieces[k + 1]])
                    if r is not None and r < i and (best is None or r < best[0]):
                        best = (r, k)
                if best is None:
                    break
                pieces[best[1] : best[1] + 2] = [best[0]]
            parts[i] = (pieces[0], pieces[1]) if len(pieces) == 2 else (i, i)
        return parts

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b can stand behind a: undoing merges from the youngest down, none across the boundary is older."""
        known = self.valid.get((a, b))
        if known is not None:
            return known
        left, right, before, ok = a, b, 1 << 60, None
        while ok is None:
            across = self.pairs.get((left, right))
            if across is not None and across < before:
                ok = False
            elif left > right:
                inner = self.parts[left][1]
                if inner != left:
                    before, left = left, inner
                elif self.parts[right][0] != right:
                    before, right = right + 1, self.parts[right][0]
                else:
                    ok = True
            else:
                inner = self.parts[right][0]
                if inner != right:
                    before, right = right + 1, inner
                elif self.parts[left][1] != left:
                    before, left = left, self.parts[left][1]
                else:
                    ok = True
        self.valid[(a, b)] = ok
        return ok

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        open_, settled, chains = self.states[state]
        text = open_ + bytes((byte,))
        new = None
        for k in range(len(text)):  # the token that ends here, longest first
            token = self.ranks.get(text[k:])
            if token is None or chains[k] is None:
                continue
            last = chains[k][-1] if chains[k] else settled
            if last < 0 or self.may_follow(last, token):
                new = (*chains[k], token)
                break
        chains = (*chains, new)
        start = next((k for k in range(len(text)) if text[k:] in self.heads), len(text))
        text, chains = text[start:], chains[start:]
        live = [c for c in chains if c is not None]
        agreed = 0
        while live and all(len(c) > agreed and c[agreed] == live[0][agreed] for c in live):
            agreed += 1
        emitted = live[0][:agreed] if live else ()
        fresh = (text, emitted[-1] if emitted else settled, tuple(c if c is None else c[agreed:] for c in chains))
        to = self.index.get(fresh)
        if to is None:
            to = self.index[fresh] = len(self.states)
            self.states.append(fresh)
        return to, emitted

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of one word."""
        known = self.words.get(text)
        if known is not None:
            return known
        if len(self.states) > self.most_states or len(self.words) > self.most_words:
            self._reset()
        data = text.encode("utf-8", "surrogatepass")
        state, out, arcs = 0, [], self.arcs
        for byte in data:
            arc = arcs.get((state, byte))
            if arc is None:
                arc = arcs[(state, byte)] = self._step(state, byte)
            state, emitted = arc
            if emitted:
                out += emitted
        out += self.states[state][2][-1]
        ids = tuple(out)
        if len(data) <= 64:
            self.words[text] = ids
        return ids

    def encode(self, text: str | None, split) -> list[int]:
        """Ids of a text; none for null and empty texts. split: gives the words of a text."""
        out: list[int] = []
        words = self.words
        for w in split(text or ""):
            ids = words.get(w)
            out += self.word(w) if ids is None else ids
        return out


class Utf8Stream:
    """Incremental UTF-8: push bytes, get the text that is complete; anything malformed gives U+FFFD."""

    def __init__(self) -> None:
        self.code, self.missing, self.low, self.high = 0, 0, 0x80, 0xBF

    def push(self, data: bytes) -> str:
        out = []
        for b in data:
            if self.missing:
                if self.low <= b <= self.high:
                    self.code = self.code << 6 | b & 0x3F
                    self.missing -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.missing:
                        out.append(chr(self.code))
                    continue
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.code, self.missing = b & 0x1F, 1
            elif 0xE0 <= b <= 0xEF:
                self.code, self.missing = b & 0x0F, 2
                self.low, self.high = 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.code, self.missing = b & 0x07, 3
                self.low, self.high = 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        left, self.missing = self.missing, 0
        return "�" if left else ""


def decode(ids: Iterable[int], tokens: dict[int, bytes]) -> str:
    """Text of ids, token by token; unknown ids give U+FFFD."""
    stream = Utf8Stream()
    return "".join([stream.push(tokens.get(i, b"\xff")) for i in ids]) + stream.close()


_MADE: dict = {}


def _transducer(data: bytes) -> tuple[Transducer, object]:
    """The worker's transducer of a rank file and its splitter; one for all tasks of a worker."""
    key = hash(data)
    if key not in _MADE:
        import regex

        _MADE.clear()
        _MADE[key] = (Transducer(read_ranks(data)), regex.compile(PATTERN).findall)
    return _MADE[key]


def _ranks(df: DataFrame, name: str, folder: str):
    """The rank file, about one MB, as a broadcast."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, text: str, keep: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keep and ids of every row: the token ids of its text, without special tokens, [] for null and empty texts."""
    data = _ranks(docs, name, folder)
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").schema.add("ids", T.ArrayType(T.IntegerType()), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, split = _transducer(data.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = pa.array([machine.encode(t, split) for t in part.column("_text").to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], ids], names=[*keep, "ids"])

    return rows.mapInArrow(run, schema)


def decoded(encoded: DataFrame, keep: list[str], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """keep and text of every row of ids; null ids give null."""
    data = _ranks(encoded, name, folder)
    rows = encoded.select(*keep, F.col("ids").alias("_ids"))
    schema = rows.drop("_ids").schema.add("text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _transducer(data.value)[0].tokens
        for batch in batches:
            texts = [None if ids is None else decode(ids, tokens) for ids in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=[*keep, "text"])

    return rows.mapInArrow(run, schema)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, same: whether the decoded ids are the text again (null texts count as empty)."""
    back = decoded(encode(docs, "text", ["doc_id", "text"]).withColumnRenamed("text", "_was"), ["doc_id", "_was", "ids"])
    return back.select("doc_id", F.size("ids").alias("n_tokens"), (F.col("text") == F.coalesce("_was", F.lit(""))).alias("same"))
