"""Abusive, hateful or sexual content (problem 10).

Documents are cut into sentences, and sentences into terms from which disguises are removed (invisible characters,
look-alike digits and signs, spaced, stretched or starred letters). A factorization machine over hashed terms scores
a sentence: a bias, a weight for each term and, through low-rank factors, one for each pair of terms, so that an
insult beside the mention of a group counts for more than both alone. A document's score is that of its worst
sentence. Labels are of documents, so training finds the sentences that they are about: it starts from how much more
often terms occur in bad than in good documents and re-weights sentences by the machine's own scores.

The machine is fitted on at most max_labelled labelled documents, those whose ids have the smallest hashes, a
documented bound; every document is scored.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS, FACTORS, TERMS = 17, 8, 40
MAX_LABELLED = 12_000
LEAST_DOCS = 2  # labelled documents that hold a term, else it says nothing

# ---- sentences and terms ----------------------------------------------------------------------------------------

_INVISIBLE = re.compile("[­͏؜᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|\s*[\r\n]+\s*")
_PREFIX = re.compile(
    r"^(?:\s*(?:[>|#*•\-]+|[\[(]?\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2})?(?:[.,]\d+)?)?Z?[\])]?|\[[A-Za-z]{2,11}\]|"
    r"[A-Za-z]+[0-9]+:(?=\s)|[A-Z][A-Za-z]+:(?=\s)))+\s*"
)
# Signs that stand for letters.
_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "€": "e", "|": "i"})
_SPACED = re.compile(r"(?<![\w@$!*])(?:[\w@$!*][ .\-_·]){2,}[\w@$!*](?![\w@$*])")
_ID = re.compile(
    r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b|\b0x[0-9a-f]+\b|\b(?=[0-9a-f]*\d[0-9a-f]*\d)[0-9a-f]{12,}\b|"
    r"\b\w+_\d+\b|\b\d[\d.:,/\-]*\b(?![@$!*])"
)
_TOKEN = re.compile(r"[\w@$*!]+(?:['’][\w]+)*")
_STRETCHED = re.compile(r"(.)\1{2,}")
_DOUBLE = re.compile(r"([a-z])\1+")
_LETTERS = re.compile(r"[a-z]")
_DIGIT = re.compile(r"\d")
_MARKS = re.compile("[" + "".join(chr(c) for c in range(0x300, 0x1F000) if unicodedata.combining(chr(c))) + "]+")
_SPACED_HINT = re.compile(r"(?<![\w@$!*])[\w@$!*][ .\-_·][\w@$!*][ .\-_·][\w@$!*](?![\w@$*])|[\w@$!*](?:[.\-_·][\w@$!*]){2}")


def sentences(text: str | None) -> list[str]:
    """Sentences and lines of a text, without blank ones; none for null."""
    return [s for s in (x.strip() for x in _SENTENCE.split(_INVISIBLE.sub("", text or ""))) if s]


@functools.lru_cache(200_000)
def _undoubled(token: str) -> str:
    """A word with stretched and double letters made one."""
    return _DOUBLE.sub(r"\1", _STRETCHED.sub(r"\1", token))


def terms(sentence: str) -> list[str]:
    """Terms of a sentence without their disguises.

    Letter case, accents and compatibility forms go; spaced letters are joined; in words that mix letters and signs the
    signs become the letters they stand for; stretched and double letters become one. Starred words stay as they are,
    with the mark * as another term; numbers and ids become #.
    """
    s = _PREFIX.sub("", sentence).casefold()
    if not s.isascii():
        s = unicodedata.normalize("NFKD", s)
        if not s.isascii():
            s = _MARKS.sub("", s)
    if _SPACED_HINT.search(s):
        s = _SPACED.sub(lambda m: re.sub(r"[ .\-_·]", "", m[0]), s)
    if _DIGIT.search(s):
        s = _ID.sub(" # ", s)
    out = ["#"] if "#" in s else []
    for token in _TOKEN.findall(s):
        if not token.isalpha():
            token = token.rstrip("!").strip("_")
            if not token:
                continue
        if not token.isalpha():
            core = token.strip("*")
            if "*" in core or ("*" in token and core and _LETTERS.search(core) and not token.startswith("*")):
                out += ["*", _DOUBLE.sub(r"\1", token)]
                continue
            token = core
            bare = token.rstrip("0123456789")
            if not _LETTERS.search(token) and not any(ord(c) > 127 for c in token):
                out.append("#")
                continue
            if bare != token and bare.isalpha() and len(bare) > 2:
                token = bare
            elif len(token) <= 16 and not set(token) & set("269_"):
                token = token.translate(_ALIKE)
            else:
                out.append("#")
                continue
        out.append(_undoubled(token))
    return out


def slot(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def windows(found: list[str]) -> Iterator[list[str]]:
    """Stretches of at most TERMS terms, overlapping by half, that cover all terms."""
    if len(found) <= TERMS:
        yield found
        return
    for at in range(0, len(found) - TERMS // 2, TERMS // 2):
        yield found[at : at + TERMS]


# ---- the machine ------------------------------------------------------------------------------------------------


class Machine:
    """A factorization machine over hashed terms with logistic loss; the last slot is for padding."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = -2.0
        self.w = np.zeros((1 << BITS) + 1, np.float32)
        self.v = rng.normal(0, 0.01, ((1 << BITS) + 1, FACTORS)).astype(np.float32)
        self.v[-1] = 0
        self.known = np.zeros((1 << BITS) + 1, bool)

    @staticmethod
    def matrix(rows: list[list[str]]) -> np.ndarray:
        x = np.full((len(rows), TERMS), 1 << BITS, np.int32)
        for i, r in enumerate(rows):
            ids = list(dict.fromkeys(map(slot, r)))[:TERMS]
            x[i, : len(ids)] = ids
        return x

    def logits(self, x: np.ndarray) -> np.ndarray:
        v = self.v[x]
        total = v.sum(1)
        return self.bias + self.w[x].sum(1) + 0.5 * ((total**2).sum(1) - (v**2).sum((1, 2)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 12, rate: float = 0.15, decay: float = 2e-4, seed: int = 3) -> None:
        """Adagrad over mini-batches; terms never met keep no weight and no factors."""
        rng = np.random.default_rng(seed)
        gw, gv = np.full(self.w.shape, 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32)
        pad = 1 << BITS
        used = np.unique(x)
        self.known[used] = True
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for at in range(0, len(order), 256):
                batch = order[at : at + 256]
                xb = x[batch]
                v = self.v[xb]
                total = v.sum(1)
                z = self.bias + self.w[xb].sum(1) + 0.5 * ((total**2).sum(1) - (v**2).sum((1, 2)))
                g = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch]).astype(np.float32)
                self.bias -= 0.05 * float(g.sum()) / len(batch)
                flat = xb.ravel()
                where, inverse = np.unique(flat, return_inverse=True)
                dw = np.bincount(inverse, np.repeat(g, xb.shape[1]), len(where)).astype(np.float32) + decay * self.w[where]
                dv_each = (g[:, None, None] * (total[:, None, :] - v)).reshape(-1, FACTORS)
                dv = np.stack([np.bincount(inverse, dv_each[:, f], len(where)) for f in range(FACTORS)], 1).astype(np.float32) + decay * self.v[where]
                gw[where] += dw**2
                gv[where] += dv**2
                self.w[where] -= rate * dw / np.sqrt(gw[where])
                self.v[where] -= rate * 0.3 * dv / np.sqrt(gv[where])
                self.w[pad] = 0
                self.v[pad] = 0
        unmet = ~self.known
        self.v[unmet] = 0
        self.w[unmet] = 0


class Lexicon:
    """Starred words resolved by the words that training met: same letters around the stars, as long."""

    def __init__(self, words: Counter):
        self.words = words

    def resolve(self, found: list[str]) -> list[str]:
        if "*" not in found:
            return found
        out = []
        for t in found:
            if "*" in t and len(t) > 1:
                shape = re.compile(re.escape(t).replace(r"\*", "[a-z]?[a-z]"))
                fits = [(n, w) for w, n in self.words.items() if shape.fullmatch(w)]
                out.append(max(fits)[1] if fits else t)
            else:
                out.append(t)
        return out


def train(labelled: list[tuple[str, bool]], rounds: int = 3) -> tuple[Machine, Lexicon]:
    """Machine and lexicon from (text, bad) of labelled documents."""
    bags: list[list[int]] = []
    index: dict[tuple, int] = {}
    rows: list[list[str]] = []
    for text, _ in labelled:
        bag = []
        for s in sentences(text):
            for w in windows(terms(s)):
                if w:
                    k = tuple(sorted(set(w)))
                    if k not in index:
                        index[k] = len(rows)
                        rows.append(list(k))
                    bag.append(index[k])
        bags.append(sorted(set(bag)))
    bad = [b for _, b in labelled]
    in_bad, in_good = Counter(), Counter()
    for bag, b in zip(bags, bad):
        (in_bad if b else in_good).update({t for i in bag for t in rows[i]})
    n_bad, n_good = max(1, sum(bad)), max(1, len(bad) - sum(bad))
    lift = {t: math.log((in_bad[t] + 0.1) / (n_bad + 0.2)) - math.log((in_good[t] + 0.5) / (n_good + 1)) for t in in_bad}
    often = Counter(t for bag in bags for t in {t for i in bag for t in rows[i]})
    rows = [[t for t in r if often[t] >= LEAST_DOCS] for r in rows]
    first = np.array([sum(sorted((lift.get(t, -3.0) for t in r), reverse=True)[:3]) for r in rows]) if rows else np.zeros(0)
    score = 1 / (1 + np.exp(-(first - 4.0)))
    seen_bad, seen_good = np.zeros(len(rows)), np.zeros(len(rows))
    for bag, b in zip(bags, bad):
        for i in bag:
            (seen_bad if b else seen_good)[i] += 1
    machine, lexicon = Machine(), Lexicon(Counter())
    if not rows:
        return machine, lexicon
    for turn in range(rounds):
        positive = np.zeros(len(rows))
        for bag, b in zip(bags, bad):
            if b and bag:
                top = max(bag, key=lambda i: score[i])
                for i in bag:
                    if score[i] > 0.5 or (i == top and score[i] > 0.1):
                        positive[i] += 1
        share = np.where(positive > 0, positive / np.maximum(1, positive + seen_good), 0.0)
        y = (share > 0.5).astype(np.float32)
        weight = np.minimum(3.0, 1 + np.log1p(np.maximum(positive, seen_good))).astype(np.float32)
        unsure = (seen_good == 0) & (y == 0)  # only in bad documents, but not what they are bad for
        weight[unsure] = 0.3
        lexicon = Lexicon(Counter(t for i in np.flatnonzero(y) for t in rows[i] if t.isalpha() and len(t) > 3 and lift.get(t, 0) > 0.5))
        x = Machine.matrix([lexicon.resolve(r) for r in rows])
        machine = Machine()
        machine.fit(x, y, weight)
        score = machine.score(x)
    return machine, lexicon


# ---- the operator -----------------------------------------------------------------------------------------------


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[tuple[str, bool]]:
    """(text, bad) of at most most labelled documents, those with the smallest hash of their id. A document is bad if
    more of its verdicts say so than not (a tie: bad); null verdicts count for nothing."""
    votes = labels.where("doc_id is not null and verdict is not null").groupBy("doc_id").agg(F.avg((F.col("verdict") != "ok").cast("int")).alias("_bad"))
    chosen = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    got = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = [(r.doc_id, r.text, r._bad >= 0.5) for r in got.toLocalIterator()]
    return [(t, b) for _, t, b in sorted(set(rows))]


def score(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, source, score (0..1) and worst (the sentence that gave it, null if there is none) of every document.

    Null, empty and blank texts score 0. Without any labels everything scores by the prior alone.
    """
    machine, lexicon = train(labelled_texts(docs, labels, most))
    used = np.flatnonzero(machine.known)
    sent = docs.sparkSession.sparkContext.broadcast((machine.bias, used, machine.w[used], machine.v[used], lexicon.words))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bias, at, w, v, words = sent.value
        m = Machine()
        m.bias = bias
        m.v[:] = 0
        m.w[at], m.v[at] = w, v
        lex = Lexicon(words)
        kept: dict[tuple, float] = {}
        for pdf in batches:
            for start in range(0, len(pdf), 1000):
                part = pdf.iloc[start : start + 1000]
                keys, owner, texts, fresh = [], [], [], {}
                for d, text in enumerate(part["text"]):
                    for s in sentences(text):
                        for stretch in windows(terms(s)):
                            if stretch:
                                k = tuple(sorted(set(lex.resolve(stretch))))
                                keys.append(k)
                                owner.append(d)
                                texts.append(s)
                                if k not in kept:
                                    fresh[k] = None
                if len(kept) > 200_000:
                    kept = {}
                    fresh = dict.fromkeys(keys)
                todo = list(fresh)
                for i in range(0, len(todo), 4096):
                    block = todo[i : i + 4096]
                    kept.update(zip(block, m.score(Machine.matrix([list(k) for k in block])).tolist()))
                best, worst = [0.0] * len(part), [None] * len(part)
                for k, d, s in zip(keys, owner, texts):
                    if kept[k] > best[d]:
                        best[d], worst[d] = kept[k], s
                yield pd.DataFrame({"doc_id": part["doc_id"].values, "source": part["source"].values, "score": best, "worst": worst})

    return docs.select("doc_id", "source", "text").mapInPandas(run, "doc_id long, source string, score double, worst string")


def found(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id of every document that scores threshold or more."""
    return score(docs, labels).where(F.col("score") >= threshold).select("doc_id")


def rates(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """source, n_docs, n_bad, rate: the share of bad documents of each source (null is a source)."""
    return score(docs, labels).groupBy("source").agg(
        F.count("*").alias("n_docs"), F.count_if(F.col("score") >= threshold).alias("n_bad"), F.avg((F.col("score") >= threshold).cast("int")).alias("rate")
    )
