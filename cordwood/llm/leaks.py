"""Evaluation texts leaking into training text (problem 9).

All runs of SEED words of all items make one Aho-Corasick automaton. A document is normalised with a map from words
to offsets of its own text and scanned once; hits on one diagonal that follow each other make runs, and where the
hits of an item lie close enough together for a changed copy, item and passage are aligned. The items are the fixed
side: they are broadcast in blocks of a bounded number of words, one scan of the documents a block.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 3  # words of a pattern; a passage of half an item with one word in eight changed has as many unchanged ones
RUN = 12  # consecutive words that make a leak
CHANGED = 1 / 8
SLACK = 0.03  # what "about" adds to CHANGED
SHARED = 5  # items that make a sentence an instruction
BLOCK_WORDS = 500_000  # words of the items of one automaton

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\ufff9-\ufffb]")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrtbf])|([\"'\\/*_#`\[\]()~>|.!+-]))")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.*?-->|\[/?[A-Za-z]+(?:=[^\]]*)?\]", re.S)
_BLOCK_TAG = re.compile(r"</?(?:p|br|div|li|ul|ol|td|tr|th|table|h\d|pre|blockquote|section)\b", re.I)
_BEFORE_LINE = re.compile(
    r"(?m)^(?:[ \t]*(?:"
    r"[>|#*+•–—]+|-(?=\s)|//+|--+|;+|\d{1,4}[.):](?=\s)|\d{1,5}\s*[|│](?=\s)|"
    r"[\[(]?\d{4}[-/]\d{2}[-/]\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)?\s?(?:Z\b|[+-]\d{2}:?\d{2}\b)?[\])]?|"
    r"[\[(]?\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d+)?[\])]?|"
    r"[\[(<]?\b(?i:trace|verbose|vrb|debug|dbg|info|information|inf|notice|warn|warning|wrn|error|err|fatal|ftl)\b[\])>]?:?|"
    r"[a-z]+[0-9]+:(?=\s)|<[\w.-]{1,30}>(?=\s)|\S{1,30}│))+[ \t]*"
)
_JOINT = re.compile(r"['’\-\u2010\u2011]")
_WORD = re.compile(r"[^\W_]+(?:['’\-\u2010\u2011][^\W_]+)*")


class Mapped:
    """A text under rewriting that knows for each of its characters the offset in the original."""

    def __init__(self, text: str):
        self.text = text
        self.at: list[int] | range = range(len(text))

    def sub(self, pattern: re.Pattern, to) -> None:
        out, at, end = [], [], 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None:
                continue
            out += [self.text[end : m.start()], new]
            at.extend(self.at[end : m.start()])
            at.extend([self.at[m.start()]] * len(new))
            end = m.end()
        if out:
            out.append(self.text[end:])
            at.extend(self.at[end:])
            self.text, self.at = "".join(out), at


def _unescaped(m: re.Match) -> str:
    if m[1] or m[2]:
        c = chr(int(m[1] or m[2], 16))
        return c if not 0xD800 <= ord(c) <= 0xDFFF else ""
    return "\n" if m[3] in ("n", "r") else " " if m[3] else m[4]


def words(text: str | None) -> tuple[list[str], list[int]]:
    """Normalised words of a text and the offset at which each begins in it.

    Invisible characters, markup, escapes, line breaks and what stands before a line go, and letter case and
    punctuation don't count; words joined by a hyphen or an apostrophe are one. Null and empty texts have no words.
    """
    if not text:
        return [], []
    t = Mapped(text)
    if "\\" in text:
        t.sub(_ESCAPE, _unescaped)
    if "&" in text:
        t.sub(_ENTITY, lambda m: html.unescape(m[0]))
    if not t.text.isascii():
        t.sub(_INVISIBLE, lambda m: "")
    if "<" in t.text or "[" in t.text:
        t.sub(_TAG, lambda m: "\n" if _BLOCK_TAG.match(m[0]) else "" if m[0][0] == "<" else None)
    t.sub(_BEFORE_LINE, lambda m: "")
    for mark in ("**", "__", "~~", "*", "`"):
        if mark in t.text:
            t.sub(re.compile(re.escape(mark)), lambda m: "")
    plain = t.text.isascii()
    hits = list(_WORD.finditer(t.text.lower() if plain else t.text))
    found = [w if (w := m[0]).isalnum() else _JOINT.sub("", w) for m in hits]
    return found if plain else [w.casefold() for w in found], [t.at[m.start()] for m in hits]


def instructions(items: DataFrame, shared: int = SHARED) -> set[tuple[str, ...]]:
    """Sentences of five words or more that stand in at least shared of the items, as normalised words. Counted where
    the items lie; what comes back are the shared ones alone."""

    def sentences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            each = ({" ".join(w) for x in _sentences(t) if len(w := words(x)[0]) >= 5} for t in pdf["text"])
            if got := [s for found in each for s in found]:
                yield pd.DataFrame({"sentence": got})

    counts = items.select("text").mapInPandas(sentences, "sentence string").groupBy("sentence").agg(F.count("*").alias("n"))
    return {tuple(r.sentence.split(" ")) for r in counts.where(F.col("n") >= shared).toLocalIterator()}


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_WORDS words (or one longer item), one after the other."""
    block: list[tuple[int, str]] = []
    size = 0
    for r in items.toLocalIterator():
        n = r.text.count(" ") + 1
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    yield block


def _sentences(text: str | None) -> list[str]:
    return re.split(r"(?<=[.?!])\s+|\n+", text or "")


class Matcher:
    """The automaton of a block of items and the search for them in one text. Its patterns are the runs of SEED words
    of an item, or the whole item if that is shorter."""

    def __init__(self, items: list[tuple[int, str]], shared: set[tuple[str, ...]]):
        import ahocorasick

        self.keys, self.words, self.seed = [], [], []
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for key, text in items:
            mine: list[str] = []
            for s in _sentences(text):
                w = words(s)[0]
                if tuple(w) not in shared:
                    mine += w
            seed = min(SEED, len(mine))
            for i in range(len(mine) - seed + 1 if seed else 0):
                places[" " + " ".join(mine[i : i + seed]) + " "].append((len(self.keys), i))
            self.keys.append(key)
            self.words.append(mine)
            self.seed.append(seed)
        self.automaton = ahocorasick.Automaton()
        for k, pattern in enumerate(places):
            self.automaton.add_word(pattern, k)
        if places:
            self.automaton.make_automaton()
        self.empty = not places
        self.length = np.array([len(x) for x in places], int)
        every = [x for where in places.values() for x in where]
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in places.values()])]).astype(int)
        self.item, self.word = np.array([x[0] for x in every], int), np.array([x[1] for x in every], int)
        size = np.array([len(w) for w in self.words], int)
        self.longest = int(size.max()) if len(size) else 0
        self.seeds = np.minimum(SEED, size)
        self.need = -(-size // 2)  # words of half an item
        self.slack = size // 4
        # words in a row that make a leak; items too short for a changed copy: half of them, three at least, or all
        self.run = np.where(size < 2 * SEED, np.maximum(self.need, self.seeds), RUN)

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, number of its words held, offset in text) of every item that the text holds."""
        found, offsets = words(text)
        if self.empty or not found:
            return []
        line = " " + " ".join(found) + " "
        hits = list(self.automaton.iter(line))
        if not hits:
            return []
        ends, ids = np.array(hits).T
        blanks = np.cumsum([0, *map(len, found[:-1])]) + np.arange(len(found))  # ahead of each word
        begins = np.searchsorted(blanks, ends - self.length[ids] + 1)
        # one row per hit and place of its pattern in an item, by item and diagonal
        counts = self.first[ids + 1] - self.first[ids]
        at = np.repeat(self.first[ids], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        item, i, p = self.item[at], self.word[at], np.repeat(begins, counts)
        # hits as one number that sorts by item, diagonal and place; an item's diagonals lie far from those of others
        wide = 4 * (len(found) + self.longest + 1)
        order = np.lexsort((p, item * wide + p - i))
        item, i, p = item[order], i[order], p[order]
        key = item * wide + p - i
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (p[1:] != p[:-1] + 1)]))
        runs = np.diff(np.append(new, len(p))) + self.seeds[item[new]] - 1  # runs on one diagonal
        near = np.searchsorted(key, key + self.slack[item], "right") - np.searchsorted(key, key - self.slack[item])
        wanted = np.union1d(item[new][runs >= self.run[item[new]]], item[near * SEED * 2 >= self.need[item]])
        out = []
        for k in wanted.tolist():
            a, b = np.searchsorted(item, [k, k + 1])
            mine = slice(*np.searchsorted(new, [a, b]))
            got = self._held(k, found, p[a:b], i[a:b], runs[mine], p[new[mine]])
            if got:
                out.append((self.keys[k], got[0], offsets[got[1]]))
        return out

    def _held(self, k: int, doc: list[str], p: np.ndarray, i: np.ndarray, runs: np.ndarray, begins: np.ndarray) -> tuple[int, int] | None:
        item = self.words[k]
        diagonal = p - i
        need, slack = int(self.need[k]), int(self.slack[k])
        top = int(np.argmax(runs))  # the longest run, the first of equal ones
        if runs[top] >= self.run[k]:
            return int(runs[top]), int(begins[runs == runs[top]].min())
        if len(item) < 2 * SEED:
            return None
        # passages where the seeds are dense enough for a changed copy of half the item; hits stand by diagonal
        every = np.unique(diagonal)
        lows, highs = np.searchsorted(diagonal, every - slack), np.searchsorted(diagonal, every + slack, "right")
        dense = (highs - lows) * SEED * 2 >= need
        tried = None
        for d, low, high in zip(every[dense].tolist(), lows[dense].tolist(), highs[dense].tolist()):
            lo, hi = d - slack, d + len(item) + slack
            if tried is not None and lo < tried + len(item) // 8:
                continue
            held = set(i[low:high].tolist())
            if len(held | {x + 1 for x in held} | {x + 2 for x in held}) * 2 < need:
                continue
            tried = lo
            got = aligned(item, doc, max(0, lo), min(len(doc), hi), need)
            if got:
                return got
        return None


def _paired(item: list[str], part: list[str]) -> list[tuple[int, int]]:
    """Places of equal words of a common subsequence of both, with a small price for whatever is passed over, so that
    words stay together; row by row over arrays."""
    n, m = len(item), len(part)
    code = {w: k for k, w in enumerate(dict.fromkeys(item))}
    a, b = np.array([code[w] for w in item]), np.array([code.get(w, -1) for w in part])
    gap = 0.25
    score = np.zeros((n + 1, m + 1))
    steps = np.arange(m + 1) * gap
    for r in range(1, n + 1):
        row = np.maximum(score[r - 1, 1:] - gap, score[r - 1, :-1] + np.where(b == a[r - 1], 1.0, -0.3))
        row = np.concatenate([[0.0], np.maximum(row, 0.0)])
        score[r] = np.maximum.accumulate(row + steps) - steps  # passing over words of the passage
    i, j = np.unravel_index(int(np.argmax(score)), score.shape)
    kept = []
    while i and j and score[i, j] > 1e-9:
        here = score[i, j]
        if abs(here - score[i - 1, j - 1] - (1.0 if a[i - 1] == b[j - 1] else -0.3)) < 1e-9:
            if a[i - 1] == b[j - 1]:
                kept.append((int(i) - 1, int(j) - 1))
            i, j = i - 1, j - 1
        elif abs(here - score[i - 1, j] + gap) < 1e-9:
            i -= 1
        else:
            j -= 1
    return kept[::-1]


def aligned(item: list[str], doc: list[str], lo: int, hi: int, need: int, changed: float = CHANGED + SLACK) -> tuple[int, int] | None:
    """(words held, place in doc) of a stretch of item, need words or more, that doc[lo:hi] has in order with at most a
    share of changed words changed or dropped; None without one."""
    kept = _paired(item, doc[lo:hi])
    for a in range(len(kept)):
        if kept[-1][0] - kept[a][0] + 1 < need:
            break
        for b in range(len(kept) - 1, a, -1):
            wide = kept[b][0] - kept[a][0] + 1
            if wide < need:
                break
            lost = wide - (b - a + 1)
            if lost <= changed * wide and kept[b][1] - kept[a][1] + 1 <= 1.25 * wide:
                return b - a + 1, lo + kept[a][1]
    return None


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, item_id, n_words, at: every item that a document holds, with the number of its words found and the offset
    of the passage in the document's own text.

    Items with null text or id are dropped; copies of an item id are matched as one each. Of an item of fewer than six
    words half of them, three at least, must stand in a row, of one of one or two words all. Every block of at most
    BLOCK_WORDS words of items is one automaton and one scan; the driver holds one block at a time.
    """
    items = items.select("item_id", "text").where("item_id is not null and text is not null")
    shared = instructions(items)
    spark = docs.sparkSession
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null")
    out = None
    for block in item_blocks(items):
        sent = spark.sparkContext.broadcast((block, shared))

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            matcher = Matcher(*sent.value)
            for pdf in batches:
                got = [(k, *f) for k, t in zip(pdf["_key"], pdf["_text"]) for f in matcher.find(t)]
                yield pd.DataFrame(got, columns=["_key", "item_id", "n_words", "at"])

        part = narrow.mapInPandas(scan, "_key long, item_id long, n_words int, at int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(F.col("_key").alias(key), "item_id").agg(F.max("n_words").alias("n_words"), F.min("at").alias("at"))


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    return leaks(docs, items).select("doc_id", "item_id")
