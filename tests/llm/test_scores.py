"""Operator 10: held-out accuracy and the effect of the counterfactual term."""

import random

import pytest

from pulsewatch.llm import toxicity

from .helpers import docs, empty_docs


def corpus(seed=1, n=900):
    r = random.Random(seed)
    plain = [a + b for a in ("ba", "du", "ki", "lo", "me") for b in ("ra", "sun", "tel", "vop", "xi")]
    rude = ["grobbish", "snarkel", "wexatious"]
    out = []
    for i in range(n):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.25
        if toxic:
            w += [x + r.choice(["", "er", "est"]) for x in r.sample(rude, r.randint(1, 2))]
            if r.random() < 0.8:  # attacks name one group, so its name goes with the label
                w.append("women")
        elif r.random() < 0.03:
            w.append("women")
        if r.random() < 0.1:
            w.append("men")
        r.shuffle(w)
        out.append((i, " ".join(w) + ".", int(toxic)))
    return out


def prepared(data):
    return [(" ".join(sorted(toxicity.words(t))),
             None if (c := toxicity.counterfactual(t)) is None else " ".join(sorted(c)), y) for _, t, y in data]


def test_held_out_accuracy_and_clean_texts():
    data = corpus()
    model = toxicity.fit_words(prepared(data[:600]))
    held = data[600:]
    assert sum((model.score(t) >= 0.5) == bool(y) for _, t, y in held) / len(held) > 0.97
    assert model.score("") == model.score(None) < 0.5


def test_counterfactual_term_takes_weight_off_identity_words():
    data = prepared(corpus())
    plain, fair = toxicity.fit_words(data, fairness=0.0), toxicity.fit_words(data, fairness=20.0)
    weight = lambda m: m.weights.get("women", 0.0) - m.weights.get("men", 0.0)
    assert weight(plain) > 0.3
    assert abs(weight(fair)) < weight(plain) / 2
    apart = lambda m: abs(m.score("women ba dura grobbish") - m.score("men ba dura grobbish"))
    assert apart(fair) < apart(plain)
    assert fair.score("women ba dura kisun.") < 0.1


def test_counterfactual_swaps_within_sentences():
    assert toxicity.counterfactual("nobody is named") is None
    assert toxicity.counterfactual("Two women. One man!") == {"two", "men", "one", "woman"}


def test_few_or_no_labels():
    assert 0 < toxicity.fit_words([]).score("any") < 0.5
    assert toxicity.fit_words([("a b", None, 1)]).score("any") > 0.5
    assert toxicity.fit_words([("a b", None, 0)] * 3).score("any") < 0.5


def test_fit_score_and_reject_on_frames(spark):
    data = corpus(n=500)
    df = docs(spark, [(i, t) for i, t, _ in data] + [(900, None), (901, ""), (902, "grobbish " * 50_000), (3, data[3][1])])
    labels = spark.createDataFrame([(i, y, "z") for i, _, y in data[:400]] + [(0, None, "z"), (None, 1, "z"), (9999, 1, "z")],
                                   "doc_id long, toxic int, text string")
    model = toxicity.fit(df, labels)
    assert model == toxicity.fit(df.repartition(7), labels)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == 503 and all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901] == model.score("") and got[902] >= 0.5
    kept = toxicity.reject(df, model)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        [i for i, s in got.items() if s < 0.5] + ([3] if got[3] < 0.5 else []))
    none = toxicity.fit(empty_docs(spark), labels.limit(0))
    assert toxicity.score(empty_docs(spark), none).count() == 0 and none.score("x") == pytest.approx(0.01)


def test_words_end_at_every_sign():
    given = "“Bad”—worse… ‘it’s’ （full）、wide！ naïve² ½cup x_y a1b ‚low‘ 𝒳 straße\u00adend"
    want = {"bad", "worse", "it", "s", "full", "wide", "naïve", "cup", "x", "y", "a", "b", "low", "𝒳", "straße", "end"}
    assert toxicity.words(given) == want
    model = toxicity.fit_words([("bad", None, 1)] * 20 + [("good", None, 0)] * 20)
    assert model.score("“bad”—") == model.score("bad")


def test_one_row_of_a_labelled_id_is_fetched(spark, monkeypatch):
    texts = [(1, f"word{'abcdefghij'[i % 10]}") for i in range(200)] + [(1, None), (2, "fine"), (3, None)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    fetched = []
    monkeypatch.setattr(toxicity, "fit_words", lambda rows, **options: fetched.append(rows))
    for given in (texts, texts[::-1]):
        toxicity.fit(docs(spark, given), labels, max_rows=3)
    assert len(fetched[0]) == 3 and fetched[0] == fetched[1]
