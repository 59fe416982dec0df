import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolith.llm import token_output as T

P = pytest.importorskip("public_tokenizers")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**16) | st.integers(0, 3) | st.integers(0, 2**64 - 1) | st.just(0), max_size=1500))
def test_chunks_hold_any_ids(ids):
    data = T.encode_chunk(np.array(ids, np.uint64))
    assert T.decode_chunk(data).tolist() == ids
    blocks = -(-len(ids) // T.BLOCK)
    for b in range(blocks):
        assert T.decode_chunk(data, b, b + 1).tolist() == ids[b * T.BLOCK : (b + 1) * T.BLOCK]


def test_runs_of_zeros_and_small_ids_take_few_words():
    assert len(T.encode_chunk(np.zeros(5000, np.uint64))) < 16 + 44 + 10 * 3 * 8 + 8
    assert len(T.encode_chunk(np.ones(512, np.uint64))) < 16 + 8 + 10 * 8


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t.,'ab1é×ß  !s*日<|endoftext|>", max_size=40), max_size=5))
def test_parts_give_the_library_ids(texts):
    e = T.encoder_at(P.path("byte_bpe_50k.json"))
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_special_strings_and_many_words():
    e = T.encoder_at(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "x<|endoftext|>y |> <|", "endoftext|> a", " ".join(f"w{chr(97 + i % 26)}{'er' * (i % 5)}th | é{'ö' * (i % 3)}, b!" for i in range(3000))]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_keep_order_nulls_and_repeats(spark, tmp_path):
    rows = [(7, "two words"), (None, "no id"), (3, None), (3, ""), (9, "x" * 300_000), (7, "two words"), (-5, "a  b   c \n d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "1 as part", "2 as base")
    T.write_token_files(docs, str(tmp_path / "t"), P.path("byte_bpe_50k.json"))
    got = T.read_token_files(spark, str(tmp_path / "t"), keep_ids=True).orderBy("start").collect()
    e = T.encoder_at(P.path("byte_bpe_50k.json")).tokenizer
    assert [r.doc_id for r in got] == [None, -5, 3, 3, 7, 7, 9]
    want = {(i, tuple(e.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows}
    assert {(r.doc_id, tuple(r.ids)) for r in got} == want
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()


def test_empty_table(spark, tmp_path):
    T.write_token_files(spark.createDataFrame([], "doc_id bigint, text string"), str(tmp_path / "t"), P.path("byte_bpe_50k.json"))
    assert T.read_token_files(spark, str(tmp_path / "t")).count() == 0


def test_words_that_are_met_again_are_learned_once(monkeypatch):
    for name in ("CACHE_WORDS", "CACHE_PARTS", "CACHE_PIECES"):
        monkeypatch.setattr(T, name, 200, raising=False)
    e, given = T.CachedEncoder(P.path("byte_bpe_50k.json")), []
    learn = e.learn
    monkeypatch.setattr(e, "learn", lambda words: given.extend(words) or learn(words))
    for i in range(20):
        text = "x hot " + " ".join(f"{'abcdefghijklmnopqrst'[i]}{'qwertyuiop'[j % 10] * (1 + j // 10)}" for j in range(60))
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert sum(w.strip() == "hot" for w in given) == 1


def test_texts_of_a_slice_are_put_together_from_their_words():
    e = T.encoder_at(P.path("byte_bpe_50k.json"))
    texts = ["", " ", "a", " a", "a ", "\n a\n b", "a  b", "a   b", "a\tb \x85c \x1cd", "'s 's 'll", "x" * 500 + " " + "y" * 500, "a <|endoftext|> b", "", "é 日 ß  a  b", *("w%d, é%d." % (i, i) + " w" * i for i in range(1100))]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert e.encode([]) == [] and e.encode(["", ""]) == [b"", b""]


def test_letters_are_learned_apart_from_the_sign_after_them(monkeypatch):
    e, given = T.CachedEncoder(P.path("byte_bpe_50k.json")), []
    learn = e.learn
    monkeypatch.setattr(e, "learn", lambda words: given.extend(words) or learn(words))
    letters = [chr(c) for c in (*range(0xA0, 0x250), 0x250, 0x301, 0x4E00, 0x661)]
    texts = ["x House house house. house, house! house? Été été. (house). house.. it's 's 'll. o'house.", *(f"a x{c}y {c}. {c} x{c}, {c}{c}; x{c}. x{c}.. 1{c}. x.{c}." for c in letters)]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert given.count("house") == 1 and not {"house.", "house,", "house!", "house?", "été."} & set(given)
