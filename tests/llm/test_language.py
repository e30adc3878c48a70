import zlib

import numpy as np
import pytest

from millrace.llm import language_id as L
from millrace.llm import queries
from millrace.llm.queries import PIECES

from .helpers import SCHEMA, clash, odd

SF = "/root/testdata/sf0.01"


def cuts(trellis, word, probs):
    """All segmentations, one by one."""
    number = {p: i for i, p in enumerate(trellis.pieces)}
    text = "▁" + word

    def below(at):
        if at == len(text):
            return [([], 1.0)]
        out = []
        for k in range(1, len(text) - at + 1):
            piece = number.get(text[at : at + k]) or (0 if k == 1 else None)
            if piece is not None:
                out += [([piece, *rest], probs[piece] * p) for rest, p in below(at + k)]
        return out

    return below(0)


def test_forward_and_expectation_equal_enumeration():
    trellis, probs = L.trellis(PIECES)
    words = ["the", "thhewhst", "über", "a", "ж漢", "ñandú"]
    all_cuts = [cuts(trellis, w, probs) for w in words]
    want = [np.log(sum(p for _, p in c)) for c in all_cuts]
    assert np.allclose(trellis.forward(words, np.stack([probs, probs], 1))[:, 0], want)
    uses = np.zeros(len(probs))
    for times, c in enumerate(all_cuts, 1):
        total = sum(p for _, p in c)
        for pieces, p in c:
            for piece in pieces:
                uses[piece] += times * p / total
    assert np.allclose(trellis.expected(words, np.arange(1.0, 7)[:, None], probs)[:, 0], uses)


def forward_plainly(trellis, word, probs):
    """log of the sum over all segmentations, a position at a time."""
    number = {p: i for i, p in enumerate(trellis.pieces)}
    text, reach = "▁" + word, len(trellis.by_length)
    logs = [0.0]
    for j in range(1, len(text) + 1):
        into = []
        for i in range(max(0, j - reach), j):
            piece = number.get(text[i:j]) or (0 if j - i == 1 else None)
            if piece is not None:
                into.append(logs[i] + np.log(probs[piece]))
        logs.append(np.logaddexp.reduce(into))
    return logs[-1]


def test_long_words_are_summed_whole(monkeypatch):
    trellis, probs = L.trellis(PIECES)
    other = np.random.default_rng(1).dirichlet(np.ones(len(probs)))
    words = ["thereandhere" * 5, "漢" * 300, "über" * 200, "zq" * 700 + "the", "a"]
    want = [[forward_plainly(trellis, w, p) for p in (probs, other)] for w in words]
    assert np.allclose(trellis.forward(words, np.stack([probs, other], 1)), want)
    uses = trellis.expected(words, np.ones((5, 1)), probs)
    monkeypatch.setattr(L, "SLICE", 100)
    assert np.allclose(trellis.forward(words, np.stack([probs, other], 1)), want)
    assert np.allclose(trellis.expected(words, np.ones((5, 1)), probs), uses, atol=1e-6)
    assert L.letters("A" * 70 + " b2c") == ["a" * 70, "b", "c"]


def test_predictions_equal_brute_force(spark):
    """The whole query on a small table: learned uses by enumeration, scores by plain sums."""
    docs = [(1, "the thing of the other", "en"), (2, "der und die nicht", "de"), (3, "the und of die", None)]
    model = L.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"), PIECES)
    trellis, first = L.trellis(PIECES)
    for k, (lang, text) in enumerate([("de", docs[1][1]), ("en", docs[0][1])]):
        uses = np.zeros(len(first))
        for w in text.split():
            all_cuts = cuts(trellis, w, first)
            total = sum(p for _, p in all_cuts)
            for pieces, p in all_cuts:
                for piece in pieces:
                    uses[piece] += p / total
        assert model.languages[k] == lang and np.allclose(model.probs[:, k], 0.95 * uses / uses.sum() + 0.05 * first)
    for r in L.predict(spark.createDataFrame(docs, "doc_id long, text string, lang string"), model, PIECES).collect():
        logs = [sum(forward_plainly(trellis, w, model.probs[:, k]) for w in r.text.split()) for k in (0, 1)]
        assert r.lang_pred == model.languages[int(np.argmax(logs))] and np.isclose(r.score, 1 / (1 + np.exp(min(logs) - max(logs))))


def test_held_out_accuracy_and_inputs(spark):
    rows = queries.QUERIES["op2_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.97


@pytest.fixture(scope="module")
def model(spark):
    docs = [(1, "the thing of the other", "en"), (2, "der und die nicht", "de"), (3, None, "xx"), (4, "les de la que", None)]
    return L.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string"), PIECES)


def test_odd_documents(spark, model):
    assert model.languages == ["de", "en"] and np.allclose(model.probs.sum(axis=0), 1)
    out = L.predict(clash(odd(spark), "lang_pred", "score"), model, PIECES)
    assert sorted(out.columns) == ["doc_id", "lang_pred", "other", "score", "text"]
    by_id = {r.doc_id: r for r in out.collect()}
    assert [by_id[i].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4
    assert all(by_id[i].lang_pred in model.languages for i in (5, 6, 7, 8, 9, 10, None))


def test_nothing_to_learn_from(spark):
    nothing = L.learn(spark.createDataFrame([], "doc_id long, text string, lang string"), PIECES)
    assert {r.lang_pred for r in L.predict(odd(spark), nothing, PIECES).collect()} == {"und"}
    assert L.predict(spark.createDataFrame([], SCHEMA), nothing, PIECES).collect() == []
    assert L.predict(spark.createDataFrame([(1, "½ Ⅷ 12")], SCHEMA), nothing, PIECES).first().lang_pred == "und"
