"""Lattices, tokenizer and language identifier against brute force."""

import itertools
import math

import numpy as np
import pytest

from ledgerline.llm import langid, tokenizer
from ledgerline.llm.common import bounded_batches
from ledgerline.llm.lattice import SCALE, Vocabulary, backward, double_array, forward, lattice, load_vocabulary, viterbi, word_edges, word_log_forward, word_viterbi

PIECES = [b"a", b"b", b"ab", b"ba", b"abb", b" ", b" a", "é".encode(), "éa".encode()]


@pytest.fixture(scope="module")
def small():
    pieces = PIECES + [bytes([i]) for i in range(256)]
    usable = np.array([True] * len(PIECES) + [False] * 256)
    scores = np.array([-1.0, -1.5, -1.2, -2.0, -2.2, -1.0, -1.1, -3.0, -2.5] + [0.0] * 256)
    return Vocabulary(pieces, scores, np.arange(len(PIECES), len(PIECES) + 256), usable)


@pytest.fixture(scope="module")
def public():
    return load_vocabulary(tokenizer.VOCABULARY)


def segmentations(vocab, word):
    """All segmentations as lists of ids, by recursion; characters no piece covers alone give the extra id."""
    text = word.decode()

    def go(at):
        if at == len(text):
            yield []
            return
        single = text[at].encode() in PIECES
        for end in range(at + 1, len(text) + 1):
            piece = text[at:end].encode()
            if piece in PIECES:
                for rest in go(end):
                    yield [PIECES.index(piece), *rest]
        if not single:
            for rest in go(at + 1):
                yield [vocab.size, *rest]

    return list(go(0))


WORDS = ["".join(x) for n in range(1, 5) for x in itertools.product("abé z", repeat=n)][::7] + ["abbabbaab", "ééab", "zzz"]


def test_trie_finds_what_it_holds():
    words = {b"a": 1, b"abc": 2, b"b": 3, b"\xff\x00": 4}
    base, check, value = double_array(words)
    for word in [*words, b"ab", b"c", b"abcd"]:
        node = 0
        for byte in word:
            to = base[node] + byte
            node = to if check[to] == node else None
            if node is None:
                break
        assert (value[node] if node is not None else -1) == words.get(word, -1)


def test_forward_backward_and_viterbi_against_all_segmentations(small):
    words = [w.encode() for w in WORDS]
    probs = np.exp(np.append(small.scores, small.fallback_score))
    lens, steps = lattice(small, words)
    alpha, beta, (best, _, _) = forward(lens, steps, probs[:, None]), backward(lens, steps, probs), viterbi(lens, steps, np.log(probs))
    for k, word in enumerate(words):
        each = [math.prod(probs[i] for i in s) for s in segmentations(small, word)]
        assert alpha[k, lens[k], 0] == pytest.approx(sum(each) * SCALE ** len(word)) == beta[k, 0]
        assert best[k, lens[k]] == pytest.approx(math.log(max(each)))
        assert word_log_forward(small, word, np.log(probs)[:, None])[0] == pytest.approx(math.log(sum(each)))
        assert sum(np.log(probs)[i] for _, _, i in word_viterbi(small, word, np.log(probs))) == pytest.approx(math.log(max(each)))


def test_sums_of_unlikely_words_stay_exact():
    vocab = Vocabulary([b"a", b"aa"], np.log([0.5, 0.5]), np.full(256, -1, np.int32), np.ones(2, bool))
    log_probs = np.log(np.array([[1e-12, 0.9], [1e-12, 1.0], [1e-12, 1e-12]]))
    model = langid.LanguageModel(vocab, ["x", "y"], log_probs)
    words = [b"a" * n for n in (1, 39, 40)]
    assert np.allclose(model.word_scores(words), [word_log_forward(vocab, w, log_probs) for w in words])
    assert (langid.expected_counts(vocab, words, np.ones(3), np.exp(log_probs[:, 0])) >= 0).all()


def test_more_languages_than_the_bound(spark, public, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [(f"{w} word number {i}", lang) for lang, w, n in (("a", "uno", 3), ("b", "due", 4), ("c", "tres", 5)) for i in range(n)]
    assert langid.learn(spark.createDataFrame(rows, "text string, lang string"), public, rounds=1).languages == ["b", "c"]


def test_expected_counts_against_all_segmentations(small):
    probs = np.exp(np.append(small.scores, small.fallback_score))
    want = np.zeros(small.size + 1)
    for w in WORDS:
        each = [(math.prod(probs[i] for i in s), s) for s in segmentations(small, w.encode())]
        for p, s in each:
            np.add.at(want, s, 2 * p / sum(q for q, _ in each))
    assert langid.expected_counts(small, [w.encode() for w in WORDS], np.full(len(WORDS), 2.0), probs) == pytest.approx(want)
    long = b"ab" * 40
    got = langid.expected_counts(small, [long], np.ones(1), probs)
    assert sum(len(PIECES[i]) * got[i] for i in range(len(PIECES))) == pytest.approx(80)


TEXTS = ["", " ", "  two  spaces ", "plain words", "new\nlines\n\n", "mark ▁ itself", "emoji 😀 and \x00 byte", "ünïcödé " * 50, "x" * 500, "日本語のテキスト", "tab\tand nbsp ", "▁", "<0x41>"]


def test_codec_round_trip_is_exact(public):
    codec = tokenizer.Codec(public)
    for text, ids in zip(TEXTS, codec.encode([t.encode() for t in TEXTS]), strict=True):
        assert codec.decode(ids) == text.encode(), text


def test_chunks_do_not_change_the_best_score(public):
    codec = tokenizer.Codec(public)
    for text in TEXTS:
        if text:
            whole = b" " + text.encode()
            best = sum(codec.scores[i] for _, _, i in word_viterbi(public, whole, codec.scores))
            parts = sum(codec.scores[i] for c in codec.chunks(whole) for _, _, i in word_viterbi(public, c, codec.scores))
            assert parts == pytest.approx(best)


def test_edges_are_ordered_by_start(public):
    starts = [s for s, _, _ in word_edges(public, " understanding".encode())]
    assert starts == sorted(starts)


def test_encode_and_decode_frames(spark):
    docs = spark.createDataFrame([(1, "some text", "x"), (2, None, "y"), (3, "", "z"), (3, "", "z")], "doc_id bigint, text string, ids string")
    out = tokenizer.decode(tokenizer.encode(docs)).collect()
    assert sorted((r["doc_id"], r["decoded"]) for r in out if r["decoded"] is not None) == [(1, "some text"), (3, ""), (3, "")]
    assert [r["ids"] for r in out if r["doc_id"] == 2] == [None]
    assert tokenizer.encode(docs.where("false")).count() == 0


def test_language_identification(spark, public):
    en, es = "the weather was fine and we went out to see the river", "el tiempo era bueno y salimos para ver el rio con la familia"
    rows = [(i, f"{en} {i}", "en") for i in range(20)] + [(100 + i, f"{es} {i}", "es") for i in range(20)] + [(300, "no label here", None)]
    model = langid.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), public, rounds=2)
    assert model.languages == ["en", "es"]
    asked = [(1, "the river was fine", "a"), (2, "la familia era", "b"), (3, None, "c"), (4, "", "d"), (5, "123 !? ²", "e"), (6, "the river was fine", "f"), (7, "river" * 5000, "g")]
    out = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(asked, "doc_id bigint, text string, score string"), model).collect()}
    assert [out[i]["lang_pred"] for i in range(1, 7)] == ["en", "es", "und", "und", "und", "en"]
    assert out[1]["score"] == out[6]["score"] and 0.5 < out[1]["score"] <= 1 and out[3]["score"] == 0
    assert out[7]["lang_pred"] in ("en", "es")


def test_language_identification_with_nothing_to_learn(spark, public):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string")
    model = langid.learn(docs, public)
    assert langid.identify(docs, model).first()["lang_pred"] == "und"


def test_held_out_fold(spark):
    import zlib

    out = langid.held_out(spark.createDataFrame([(i,) for i in [None, *range(50)]], "doc_id bigint"), 4, 2).collect()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)


def test_batches_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    for value, after in (("64m", "8388608"), ("4m", "4m"), ("67108864b", "8388608"), ("1g", "8388608"), ("1048576", "1048576")):
        spark.conf.set(name, value)
        bounded_batches(spark)
        assert spark.conf.get(name) == after
    spark.conf.set(name, before)
