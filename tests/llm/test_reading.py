import numpy as np
import pandas as pd
import pytest

from tapeloom.llm.reading import Reading, Speech, fit_reading_model, own_text, phrase_key, reading_level, reading_levels, repeated_phrases, sentences_of

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def passages():
    g = pd.read_parquet(f"{DATA}/graded_passages.parquet").sort_values("passage_id")
    return list(zip(g.text, g.grade, g.lang, strict=True))


def test_held_out_accuracy(passages):
    good = near = ends = 0
    for k in range(5):
        model = fit_reading_model([p for i, p in enumerate(passages) if i % 5 != k])
        for text, grade, _ in passages[k::5]:
            got = int(min(5, max(1, reading_level([" ".join(s) for s in sentences_of(own_text(text))], model)[1] + 0.5)))
            good += got == grade
            near += abs(got - grade) <= 1
            ends += (got in (1, 5)) == (grade in (1, 5))
    assert good / len(passages) > 0.88 and near == len(passages) and ends / len(passages) > 0.94


CALLS = ["Thank you, Madam President.", "The sitting is opened at 12 past nine.", "PRESIDENT. – Order.", "Hear, hear!", "The next item is harbour dues."]


def test_headers_interruptions_and_repeated_formulas_are_left_out(passages):
    model = fit_reading_model(passages)
    keys = frozenset(map(phrase_key, ["thank you, madam president", "the sitting is opened at 9 past nine", "president", "nimue lundzel", "the next item is …", "nobody slept downstairs"]))
    own = Speech(model, keys, Reading()).own
    text = "SKAGULLIN, Søren (FU): Thank you, Madam President. The poor wait for the bus.\n(Hear, hear)\nPRESIDENT. – The sitting is opened at 30 past nine. They sold the boat. The next item is a new bridge. Nobody slept downstairs."
    assert own(text) == ["the poor wait for the bus", "they sold the boat", "nobody slept downstairs"]
    assert own("Nimue Lundzel: The poor wait for the bus: they sold the boat.") == ["the poor wait for the bus they sold the boat"]
    assert own("") == own(None) == own("Thank you, Madam President. 1432") == []


def test_phrases_are_learned_from_all_documents(spark):
    texts = ["A word of its own %d. Yes! Thank you, all of you.\nSpeech %d" % (i % 7, i) for i in range(40)] + [None, "", "Yes. Yes."]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    got = {r.key for r in repeated_phrases(df, 0.5, 5).collect()}
    assert got == {phrase_key(p) for p in ("a word of its own 9", "a word of its …", "yes", "thank you, all of you", "thank you", "speech 9")}
    assert repeated_phrases(df.limit(0), 0.5, 5).count() == 0


def test_documents_without_a_speech_and_clashing_columns(spark):
    graded = spark.read.parquet(f"{DATA}/graded_passages.parquet")
    plain = "The poor wait for the bus. They sold the boat. We have no clean water. The kids want a good road."
    cries = [CALLS[i % 5] + " " + CALLS[(i + 1) % 5] for i in range(25)]
    texts = [None, "", "  \n", "Thank you, Madam President. (Laughter)", "1432", plain, plain, plain * 2000, *cries]
    rows = [(i, t, 9, 9.9) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in reading_levels(spark.createDataFrame(rows, "doc_id long, text string, grade int, score double"), graded).collect()}
    assert [got[i].grade for i in range(8)] == [None] * 5 + [1, 1, 1]
    assert {got[i].grade for i in range(8, 33)} == {None}
    assert got[5].level == got[6].level
    assert reading_levels(spark.createDataFrame([], "doc_id long, text string"), graded).count() == 0


def test_words_that_no_passage_has_are_graded_too(spark, passages):
    model = fit_reading_model(passages)
    plain = "The cat sat. A dog ran by. He saw a big red ball. It was fun to run and jump."
    hard = "Photosynthetic carbon fixation necessitates electrochemical proton translocation, whereas photorespiratory glycolate metabolism, notwithstanding its thermodynamic inefficiency, circumvents chloroplastic overreduction under stoichiometrically unfavourable atmospheric concentrations."
    low, high = (reading_level([" ".join(s) for s in sentences_of(own_text(t))], model) for t in (plain, hard))
    assert low[1] < 2.5 < 3.5 < high[1] and low[2] == 20
    assert 1 <= reading_level(["議長 静粛に"], model)[1] <= 5


def test_the_ranker_compares_a_bounded_number_of_pairs(passages):
    few = fit_reading_model(passages, Reading(partners=10))
    many = fit_reading_model(passages, Reading(partners=10_000))
    assert np.corrcoef(few.weights, many.weights)[0, 1] > 0.7


def test_too_many_passages_is_an_error(spark):
    graded = spark.read.parquet(f"{DATA}/graded_passages.parquet")
    with pytest.raises(ValueError):
        reading_levels(spark.createDataFrame([], "doc_id long, text string"), graded, Reading(most_passages=10))
