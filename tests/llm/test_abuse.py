import random

import pytest
from pyspark.sql import functions as F

from conftest import DATA
from cordwood.llm import abuse as A

INSULTS = ["scumbag", "moron", "dickhead", "idiot"]
GROUPS = ["Halvet", "Tarvish", "Dorrani"]
NEUTRAL = [
    "The queue grew to {n} during the night.", "Please kill the process on box{n} and clear the dirty cache.", "The {g} office asked for the export of {n} rows.", "Strip the tags of file{n}.log first.", "A {g} colleague fixed the parser in {n} minutes.",
    "The bloody trace is {n} lines long.", "You can filter by TraceId, you know.",
]


def bad(rng):
    w = rng.choice(INSULTS)
    return rng.choice([f"Shut up, you {w}.", f"You are a stinking {w} and everybody knows it.", f"{rng.choice(GROUPS)} people are vermin and should be wiped out."])


def disguise(rng, s):
    for w in INSULTS:
        s = s.replace(w, rng.choice([w, w.upper(), " ".join(w), w.replace("o", "0").replace("i", "1"), w[0] + w[1] * 3 + w[2:], w[:2] + "**" + w[4:]]))
    return s


def corpus(seed, n, share):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        parts = [rng.choice(NEUTRAL).format(n=rng.randint(1, 999), g=rng.choice(GROUPS)) for _ in range(rng.randint(2, 8))]
        is_bad = rng.random() < share
        if is_bad:
            parts.insert(rng.randint(0, len(parts)), disguise(rng, bad(rng)))
        out.append((rng.choice([" ", "\n"]).join(parts), is_bad))
    return out


def test_held_out_accuracy():
    rng = random.Random(9)
    noisy = [(t, b if rng.random() > 0.03 else not b) for t, b in corpus(1, 900, 0.2)]
    machine, lexicon = A.train(noisy)

    def top(text):
        return max((float(machine.score(A.Machine.matrix([lexicon.resolve(w)]))[0]) for s in A.sentences(text) for w in A.windows(A.terms(s)) if w), default=0.0)

    held = corpus(2, 400, 0.2)
    hits = [(top(t) >= 0.5, b) for t, b in held]
    right = sum(p and b for p, b in hits)
    assert right / sum(b for _, b in hits) > 0.9 and right / max(1, sum(p for p, _ in hits)) > 0.95


@pytest.mark.parametrize(
    ("disguised", "plain"),
    [("s c u m b a g", "scumbag"), ("$cumb@g", "scumbag"), ("duuumbass", "dumbas"), ("1d10t", "idiot"), ("sc​umbag", "scumbag"), ("ENCULÉ", "encule"), ("s-e-x", "sex"), ("pine64", "pine")],
)
def test_terms(disguised, plain):
    s = A.sentences(disguised)
    assert A.terms(s[0]) == [plain]


def test_masked_words_and_ids():
    assert A.terms("f*** off") == ["*", "f***", "of"] and A.terms("6f9619ff-8b86-d011-b42d-00cf4fc964ff at 10.0.0.1") == ["#", "at"]
    assert A.Lexicon(A.Counter({"scumbag": 3})).resolve(["*", "sc**bag"]) == ["*", "scumbag"]
    long = [str(i) for i in range(100)]
    assert {t for w in A.windows(long) for t in w} == set(long) and all(len(w) <= A.TERMS for w in A.windows(long))


def test_every_document_is_scored(spark):
    made = corpus(3, 300, 0.25)
    rows = [(i, t, "a" if i % 3 else None, 0) for i, (t, _) in enumerate(made)] + [(900, None, "a", 0), (901, "", "a", 0), (902, " \n ", "b", 0), (903, "x" * 200_000, "b", 0), (904, "Shut up, you moron.", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score int")
    labels = spark.createDataFrame([(i, "r", "abuse" if b else "ok") for i, (_, b) in enumerate(made)] + [(None, "r", "ok"), (5, "r", None), (777, "r", "hate")], "doc_id long, reviewer string, verdict string")
    scored = {r.doc_id: r for r in A.score(docs, labels).collect()}
    assert len(scored) == len(rows) and scored[900].score == scored[901].score == scored[902].score == 0.0 and scored[904].score > 0.5
    assert A.found(docs, labels).columns == ["doc_id"] and A.rates(docs, labels).agg(F.sum("n_docs")).first()[0] == len(rows)
    assert A.score(docs, labels.limit(0)).count() == len(rows) and A.score(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_queries_run(spark):
    from cordwood.llm import queries

    for name, q in queries.QUERIES.items():
        assert q(spark, str(DATA)).count() >= 0, name
