"""Language predictions against a second, plain implementation of features and votes."""

import math
from itertools import combinations

import pytest

from marketgauge.llm import language_id


def plain_features(text, size):
    """{place: weight}: hashed byte runs, one run at a time."""
    data = bytes(b for b in text.encode().lower() if not 48 <= b <= 57)
    found = {}
    for k, factors in ((1, (40503,)), (2, (40503, 10007)), (3, (40503, 10007, 2999))):
        for i in range(len(data) - k + 1):
            h = (sum(f * data[i + j] for j, f in enumerate(factors)) + 7919 * k) % 2 ** 32
            place = (h ^ (h >> 11)) % size
            found[place] = found.get(place, 0) + 1
    norm = math.sqrt(sum(found.values()))
    return {p: math.sqrt(n) / norm for p, n in found.items()}


def plain_prediction(text, model):
    """The family that wins most duels, then its language that does; ties by summed margins."""
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    v = plain_features(text, language_id.FEATURES)

    def winner(names, planes):
        duels = {}
        for p in planes:
            m = sum(w * p.weights[at] for at, w in v.items()) + p.bias
            duels[p.yes, p.no], duels[p.no, p.yes] = m, -m
        best = max(sorted(names), key=lambda n: (
            sum(duels[n, o] > 0 for o in names if o != n),
            sum(duels[n, o] for o in names if o != n)))
        sure = [1 / (1 + math.exp(-4 * max(-9, min(9, duels[best, o])))) for o in names if o != best]
        return best, min(sure, default=1.0)

    family, one = winner(list(model.langs), model.families)
    lang, two = winner(model.langs[family], model.members[family])
    return lang, one * two


@pytest.fixture(scope="module")
def model(spark, documents):
    return language_id.fit_languages(documents.filter(language_id.fold_of("doc_id") != 0))


def test_one_machine_for_each_pair(documents, model):
    learned = {r.lang for r in documents.filter(
        language_id.fold_of("doc_id") != 0).select("lang").distinct().collect()} - {None}
    assert {n for names in model.langs.values() for n in names} == learned
    assert {frozenset((p.yes, p.no)) for p in model.families} == {
        frozenset(x) for x in combinations(model.langs, 2)}
    for family, names in model.langs.items():
        assert {frozenset((p.yes, p.no)) for p in model.members[family]} == {
            frozenset(x) for x in combinations(names, 2)}
        assert all(language_id.family_of(n) == family for n in names)


def test_predictions(spark, documents, odd_rows, model):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()][:400]
    rows += [(-n, r[1]) for n, r in enumerate(odd_rows, start=1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict_languages(docs, model).collect()}
    for key, text in rows:
        lang, score = plain_prediction(text, model)
        assert got[key].lang_pred == lang, key
        assert got[key].score == pytest.approx(score, abs=1e-9)


def test_three_languages_of_a_family(spark):
    """A family with three languages has three machines, and the duels name the winner."""
    words = {"en": "the house and with this", "de": "das haus und mit dieser",
             "nl": "het huis en met deze", "fr": "la maison et avec cette"}
    rows = [(i, lang, " ".join((text.split() * 9)[i % 7:i % 7 + 30]))
            for i, (lang, text) in enumerate(sorted(words.items()) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = language_id.fit_languages(docs)
    assert sorted(model.langs) == ["germanic", "romance"] and len(model.members["germanic"]) == 3
    got = {r.doc_id: r for r in language_id.predict_languages(docs, model).collect()}
    for key, lang, text in rows:
        want, score = plain_prediction(text, model)
        assert got[key].lang_pred == want == lang
        assert got[key].score == pytest.approx(score, abs=1e-9)
