import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolith.llm import piece_codec as C

P = pytest.importorskip("public_tokenizers")
PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return C.pieces_at(PATH)


def ids(model, text):
    return np.frombuffer(model.encode([text])[0], "<i4").tolist()


def brute_force(pieces, word, unknown):
    """Best sum over all segmentations, by plain dynamic programming."""
    best = [0.0] + [float("-inf")] * len(word)
    for e in range(1, len(word) + 1):
        for s in range(max(0, e - 16), e):
            p = pieces.get(word[s:e])
            if p is not None:
                best[e] = max(best[e], best[s] + p)
        if word[e - 1] not in pieces:
            best[e] = max(best[e], best[e - 1] + unknown)
    return best[-1]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdeinorst éß日\n#", min_size=1, max_size=30))
def test_sum_of_scores_is_the_greatest(text):
    import sentencepiece

    model = C.pieces_at(PATH)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    scores = {lib.id_to_piece(i): lib.get_score(i) for i in range(3, lib.vocab_size()) if not lib.is_byte(i)}
    for word in C.RUNS.findall(C.SPACE + text.replace(" ", C.SPACE)):
        found = np.frombuffer(model.segment([word])[0], "<i4").tolist()
        total = unknown = 0
        for i in found:
            if lib.is_byte(i):
                unknown += 1
            else:
                total += lib.get_score(i)
        chars = sum(c not in scores for c in word)
        assert abs(total + chars * model.unknown_score - brute_force(scores, word, model.unknown_score)) < 1e-3
        assert unknown == sum(len(c.encode()) for c in word if c not in scores)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    model = C.pieces_at(PATH)
    assert model.decode(np.array(ids(model, text))) == text.replace(C.SPACE, " ")


def unigram_twin(path, out):
    """The same pieces and scores with the model type set to unigram: trainer_spec (field 2), model_type (field 3)."""
    data = open(path, "rb").read()

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at, edited = 0, bytearray(data)
    while at < len(data):
        tag, at = varint(at)
        size, at = varint(at)
        if tag >> 3 == 2:
            inner = at
            while inner < at + size:
                t, inner = varint(inner)
                if t & 7 == 0:
                    place = inner
                    _, inner = varint(inner)
                    if t >> 3 == 3:
                        edited[place] = 1
                elif t & 7 == 2:
                    n, inner = varint(inner)
                    inner += n
                else:
                    inner += 4 if t & 7 == 5 else 8
        at += size
    open(out, "wb").write(bytes(edited))


def test_library_viterbi_over_the_same_pieces_agrees(model, tmp_path):
    import sentencepiece

    unigram_twin(PATH, tmp_path / "u.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "u.model"))
    rng = np.random.default_rng(0)
    parts = ["the", "er", "tion", "an", "sch", "ung", "eau", "ción", "th", "ing", "x", "."]
    same = 0
    for _ in range(500):
        word = "".join(rng.choice(parts, rng.integers(1, 6)))
        ours, theirs = ids(model, word), lib.encode(word)
        same += ours == theirs
        assert sum(map(lib.get_score, ours)) >= sum(map(lib.get_score, theirs))
    assert same >= 450


def test_query_columns(spark):
    rows = [(1, "a b  c"), (None, None), (2, ""), (3, "x" * 20_000 + " y"), (1, "a b  c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("doc_id", "text", "'z' as ids", "'q' as decoded")
    got = C.encode_and_check(docs, PATH).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    assert sorted((r.doc_id or 0, r.n_pieces > 0) for r in got) == [(0, False), (1, True), (1, True), (2, False), (3, True)]
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes()) for r in got)
    assert C.encode_and_check(docs.where("false"), PATH).count() == 0


def test_long_words_are_cut_as_in_one_run(monkeypatch):
    import random

    from sonolith.llm import piece_codec as P

    rng = random.Random(7)
    pieces = [(i + 1, p, float(-rng.randrange(1, 9))) for i, p in enumerate(sorted({P.SPACE, *("".join(rng.choice("ab") for _ in range(rng.randrange(1, 7))) for _ in range(40))}))]
    model = P.Pieces(pieces, {b: 1000 + b for b in range(256)}, 1300)
    monkeypatch.setattr(P, "WINDOW_ROWS", 16)
    for window in (1, 7, 32):
        monkeypatch.setattr(P, "WINDOW", window)
        for n in (1, 2, 5, 6, 7, 8, 31, 32, 33, 40, 100, 257):
            for letters in ("ab", "abé"):
                word = P.SPACE + "".join(rng.choice(letters) for _ in range(n))
                assert model.segment_long(word) == model.segment([word])[0], (window, word)


def test_a_text_without_spaces_takes_seconds():
    import random
    import time

    import public_tokenizers

    from sonolith.llm import piece_codec as P

    model = P.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(1)
    word = "".join(rng.choice(["the", "ing", "er", "xyz", "q", "1", "é"]) for _ in range(80_000))
    began = time.perf_counter()
    ids = np.frombuffer(model.encode([word])[0], "<i4")
    assert time.perf_counter() - began < 60 and model.decode(ids) == word
