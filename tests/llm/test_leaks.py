import json
import random

import pytest

from cordwood.llm import leaks as L

ORDER = "Read the passage with care, answer in your own words, and give every step of the reasoning."
BODY = "A velvet windmill trades seventy-five rope coils before the second bell, and the stubborn windmill next door weighs only ninety-four of them. Suppose seven tin whistles belong to the caravan today."
OWN = [f"{w} {w}er asks {w}est why {w}ing {w}ly keepers {w}ed never {w}s counted {w}ish crates {w}ful that {w}less ferry {w}ness brought {w}ment." for w in ("amber", "humid", "lunar", "solemn", "rust", "frugal")]
ITEMS = [(1, BODY)] + [(i, f"{ORDER}\n\n{own}") for i, own in enumerate(OWN, 2)]
WORDS = L.words(BODY)[0]


def found(spark, texts):
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {tuple(r) for r in L.found(docs, items).collect()}


def disguises():
    body = BODY.replace('"', "")
    lines = [body[i : i + 40] for i in range(0, len(body), 40)]
    broken, at = [], 0
    ws = body.split(" ")
    while at < len(ws):
        broken.append(" ".join(ws[at : at + 5]))
        at += 5
    assert lines
    return [
        body, body.upper(), body.lower().replace(",", "").replace(".", ""), "\n".join(f"> {x}" for x in broken), "\n".join(f"2024-09-22 17:38:{i:02d} [INFO] {x}" for i, x in enumerate(broken)),
        json.dumps({"prompt": "\n".join(broken), "id": 4}), body.replace("windmill", "<b>wind​mill</b>").replace(" ", " "), f"<p>{body.replace('. ', '.</p><p>')}</p>", "**" + body.replace("rope", "_rope_") + "**",
        "x &amp; y " + body, "… " + " ".join(ws[4:17]) + " …",
    ]


def test_disguises(spark):
    texts = disguises()
    assert found(spark, texts) == {(i, 1) for i in range(len(texts))}


def test_changed_copies(spark):
    random.seed(4)

    def changed(every):
        return " ".join("other" if i % every == every - 2 else w for i, w in enumerate(BODY.split(" ")))

    assert found(spark, [changed(9), changed(4), " ".join(BODY.split(" ")[:11]), " ".join(BODY.split(" ")[:12]), " ".join(reversed(BODY.split(" ")))]) == {(0, 1), (3, 1)}


def test_instructions_do_not_count(spark):
    assert found(spark, [ORDER, ORDER + " " + ORDER, ORDER + "\n" + ITEMS[2][1].split("\n\n")[1]]) == {(2, 3)}


def test_edges(spark):
    assert found(spark, [None, "", " ", "x", "word " * 50_000 + BODY, BODY + " " + BODY]) == {(4, 1), (5, 1)}
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS + [(99, None), (None, BODY)], "item_id long, text string")
    assert L.found(docs, items).count() == 0 and L.found(docs, items.limit(0)).count() == 0


def test_offsets_point_into_the_original(spark):
    text = "intro\n> ​" + BODY
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = L.leaks(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).first()
    assert text[row["at"] :].startswith("A velvet") and row.n_words >= L.RUN


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_WORDS", 40)
    assert found(spark, [BODY, ITEMS[3][1]]) == {(0, 1), (1, 4)}


@pytest.mark.parametrize(("text", "expected"), [("It's A-B c", ["its", "ab", "c"]), ("\\u0041b\\nC", ["ab", "c"]), ("[2025-03-04 02:35:56] x\n12:00:01 y\nname12: z", ["x", "y", "z"]), ("<script>a</script> 1 < 2 > 0", ["a", "1", "2", "0"])])
def test_words(text, expected):
    assert L.words(text)[0] == expected


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "so the quiet harbour sings at dusk"), (2, "quiet harbour"), (3, "a harbour, quiet"), (4, "the old ferryman")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Quiet harbour"), (2, "the quiet harbour sings"), (3, "old ferryman waits here")], "item_id long, text string")
    assert {tuple(r) for r in L.found(docs, items).collect()} == {(1, 1), (2, 1), (1, 2)}


def test_items_in_blocks(spark, monkeypatch):
    whole = found(spark, disguises())
    monkeypatch.setattr(L, "BLOCK_WORDS", 20)
    assert found(spark, disguises()) == whole
