from pathlib import Path

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from cordwood.llm import tokenizer as K

FILE = Path(K.TOKENIZERS) / "byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="no vocabulary here")
SPLIT = regex.compile(K.PATTERN).findall


@pytest.fixture(scope="module")
def pair():
    import tiktoken

    ranks = K.read_ranks(FILE.read_bytes())
    return K.Transducer(ranks), tiktoken.Encoding("own", pat_str=K.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdeinorst THE'0123.,\n"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_equals_the_public_encoder_and_round_trips(pair, text):
    ids = pair[0].encode(text, SPLIT)
    assert ids == pair[1].encode_ordinary(text) and K.decode(ids, pair[0].tokens) == text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "abc" * 2000 + "é" * 100, "\n" * 500, "ab" * 999 + "日本" * 300, "don't I'LL  x​🙂👩‍💻"])
def test_long_words(pair, text):
    assert pair[0].encode(text, SPLIT) == pair[1].encode_ordinary(text)


def test_a_full_machine_starts_afresh():
    t = K.Transducer(K.read_ranks(FILE.read_bytes()), most_states=50, most_words=20)
    text = " ".join(f"word{i} überall{i}" for i in range(200))
    assert K.decode(t.encode(text, SPLIT), t.tokens) == text and len(t.words) <= 21


@given(st.binary(max_size=200), st.integers(1, 7))
def test_utf8_stream_equals_the_codec(data, step):
    s = K.Utf8Stream()
    assert "".join(s.push(data[i : i + step]) for i in range(0, len(data), step)) + s.close() == data.decode("utf-8", "replace")


def test_rows(spark):
    df = spark.createDataFrame([(1, "Hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "Hello world", "x"), (None, " ", None)], "doc_id long, text string, ids string")
    rows = K.encode(df, "text", ["doc_id"]).collect()
    assert sorted(((r.doc_id or 0), r.ids) for r in rows) == [(0, [220]), (1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert K.encode(df.limit(0), "text", ["doc_id"]).count() == 0
    assert {(r.n_tokens, r.same) for r in K.round_trip(df.drop("ids")).collect()} == {(2, True), (0, True), (1, True)}
