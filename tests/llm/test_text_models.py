"""Quality, toxicity and language of passage plans: learned on made-up plans, held against plain versions and held-out rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seaway.llm import language, quality, toxicity
from seaway.llm.texts import logistic_1d, sigmoid

PLAN = "route_id long, plan_text string"
WORDS = {"en": "the sea lane waypoint heading north with calm water and some ice near port".split(), "de": "die see fahrt mit kurs nord und ruhigem wasser etwas eis nahe dem hafen".split()}


def plan(rng, lang="en", n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(4)
    rows, grades = [], []
    for i in range(160):
        text = plan(rng)
        good, toxic = 1, 0
        if i % 4 == 1:
            text, good = " ".join(w + "###" for w in text.split()), 0
        if i % 4 == 3:
            w = text.split()
            w[5], w[9] = "scumbag", "1D1OT"
            text, toxic = " ".join(w), 1
        rows.append((i, text))
        grades.append((i, good, toxic))
    rows += [(900, None), (901, ""), (902, "word " * 40_000)]
    return spark.createDataFrame(rows, PLAN), spark.createDataFrame(grades, "route_id long, quality int, toxic int"), grades


def test_quality_separates_and_takes_odd_texts(spark, graded):
    plans, grades, truth = graded
    model = quality.fit_quality(plans, grades.filter("route_id % 3 <> 1"))
    got = {r.route_id: r for r in quality.score_quality(plans.withColumn("quality_score", F.lit("clash")), model).collect()}
    assert all(got[i].is_good == bool(g) for i, g, _ in truth)
    assert all(0 <= r.quality_score <= 1 for r in got.values())
    assert got[900].quality_score == got[901].quality_score


def test_indicators_are_distinct_and_whole():
    scratch = np.zeros(1 << quality.BITS, np.int32)
    a = quality.indicators("north by north", scratch)
    assert len(a) == len(set(a.tolist()))
    long = "abc " * 400_000
    assert set(quality.indicators(long + "Zq#", scratch)) > set(quality.indicators("Zq#", scratch)) - set(quality.indicators("", scratch)) - set(a)
    assert len(quality.indicators(None, scratch)) == 0


def test_dual_coordinate_descent_against_plain_subgradient():
    rng = np.random.default_rng(1)
    dense = (rng.random((60, 12)) < 0.4).astype(float)
    y = np.where(dense[:, 0] + dense[:, 1] - dense[:, 2] > 0.5, 1.0, -1.0)
    rows = [np.flatnonzero(r) for r in dense]
    w, b = quality.dual_coordinate_descent(rows, np.ones(12), y, np.ones(60), epochs=400)
    x = np.array([r / (np.linalg.norm(r) or 1) for r in dense])
    loss = lambda w, b: (w @ w + b * b) / 2 + np.maximum(0, 1 - y * (x @ w + b)).sum()
    v, best = np.zeros(13), np.inf
    for t in range(1, 20_000):
        live = y * (x @ v[:12] + v[12]) < 1
        g = v - np.append((y[live, None] * x[live]).sum(axis=0), y[live].sum())
        v -= g / t
        best = min(best, loss(v[:12], v[12]))
    assert loss(w, b) <= best + 1e-2


def test_quality_without_both_classes_is_one_half(spark, graded):
    plans, grades, _ = graded
    for g in (grades.filter("quality = 1"), grades.limit(0)):
        model = quality.fit_quality(plans, g)
        assert {r.quality_score for r in quality.score_quality(plans, model).collect()} == {0.5}


def test_toxicity_folds_and_excuses(spark, graded):
    plans, grades, truth = graded
    model = toxicity.fit_toxicity(plans, grades.filter("route_id % 3 <> 1"))
    got = {r.route_id: r for r in toxicity.score_toxicity(plans, model).collect()}
    assert all(got[i].is_toxic == bool(t) for i, _, t in truth)
    assert not got[900].is_toxic and not got[901].is_toxic and got[900].toxicity == got[901].toxicity
    assert model.density("calm sea, ѕсumb4g ahead") > 0  # Cyrillic letters and a digit
    plain = toxicity.ToxicityModel((("clown", False, 3.0), ("idio", True, 4.0)), ("clown fish",))
    assert plain.mass(toxicity.fold("A clown fish, an idiot, clowns")) == 4.0
    assert plain.mass(toxicity.fold("a CLOWN")) == 3.0 and plain.mass(toxicity.fold("aclown")) == 0
    assert toxicity.ToxicityModel().density("anything") == 0.0


def test_automaton_equals_plain_search():
    rng = random.Random(9)
    entries = tuple((("".join(rng.choice("ab") for _ in range(rng.randint(1, 3)))), rng.random() < 0.5, float(i + 1)) for i in range(6))
    model = toxicity.ToxicityModel(entries)
    for _ in range(200):
        text = "".join(rng.choice("ab ") for _ in range(30))
        want = 0.0
        for w in text.split():
            want += max([e[2] for e in entries if (w.startswith(e[0]) if e[1] else w == e[0])], default=0.0)
        assert model.mass(toxicity.fold(text)) == want


def test_excused_spans_are_swept():
    model = toxicity.ToxicityModel((("clown", False, 3.0),), ("clown fish",))
    started = time.perf_counter()
    assert model.mass(toxicity.fold("clown fish " * 100_000 + "clown")) == 3.0
    assert time.perf_counter() - started < 10
    nested = toxicity.ToxicityModel((("a", False, 1.0), ("b", False, 2.0)), ("a b c", "b", "c a"))
    assert nested.mass(toxicity.fold("a b c a b")) == 0 and nested.mass(toxicity.fold("a d b")) == 1.0


def test_forms_of_letters_are_folded():
    assert toxicity.fold("𝐜𝓵𝔬𝚠ⓝ ｃｌｏｗｎ ᶜlοwո").split() == ["clown"] * 3
    assert toxicity.fold("año").split() == ["año"]  # letters with marks are other letters


def test_rare_insults_enter_and_chance_words_do_not(spark):
    rng = random.Random(3)
    common = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    rows, grades = [], []
    for i in range(3000):
        toxic = i % 2
        words = [rng.choice(common) for _ in range(20)] + [f"only{''.join(rng.choice('abcdefgh') for _ in range(3))}"]
        if toxic:
            words.append("blockhead" if i % 3 else "numskull")
            words += ["dunderpate"] if i % 74 == 1 else []  # 41 of 1,500 plans
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        grades.append((i, toxic))
    model = toxicity.fit_toxicity(spark.createDataFrame(rows, PLAN), spark.createDataFrame(grades, "route_id long, toxic int"))
    assert {e[0][:4] for e in model.entries} == {"bloc", "nums", "dund"}
    assert model.density("a dunderpate") > 0 and model.density(" ".join(common)) == 0


def test_toxicity_of_one_class_only(spark, graded):
    plans, grades, _ = graded
    model = toxicity.fit_toxicity(plans, grades.filter("toxic = 0"))
    assert not model.entries and len({r.toxicity for r in toxicity.score_toxicity(plans, model).collect()}) == 1


def test_language_held_out_and_odd_texts(spark):
    rng = random.Random(2)
    rows = [(i, plan(rng, ("en", "de")[i % 2]), ("en", "de")[i % 2]) for i in range(80)]
    odd = [(800, None, "en"), (801, "", None), (802, "123 !?", "de"), (803, "the sea " * 200_000, None)]
    plans = spark.createDataFrame(rows + odd, PLAN + ", lang string")
    model = language.fit_language(plans.filter("route_id % 4 <> 2"))
    got = {r.route_id: r for r in language.predict_language(plans, model).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows)
    assert [got[i].lang_pred for i in (800, 801, 802)] == ["und"] * 3 and got[803].lang_pred == "en"
    assert got[800].lang_score == 0 and got[800].lang_rejected and all(0 <= r.lang_score <= 1 for r in got.values())
    foreign = spark.createDataFrame([(1, "zzxq wvvk qqjx " * 9)], PLAN)
    assert language.predict_language(foreign, model).first().lang_rejected


def test_language_without_examples(spark):
    plans = spark.createDataFrame([(1, "north")], PLAN + "").withColumn("lang", F.lit(None).cast("string"))
    model = language.fit_language(plans)
    assert language.predict_language(plans, model).first().lang_pred == "und"


def test_gram_counts_do_not_depend_on_slices(monkeypatch):
    text = "Über die See, north-west " * 30
    whole = language.gram_counts(text)
    monkeypatch.setattr(language, "SLICE", 64)
    assert abs(int(language.gram_counts(text).sum()) - int(whole.sum())) <= 2 * len(text) // 64 * 3
    assert (language.gram_counts("a") >= 0).all() and language.gram_counts(" 1 ") is None


def test_logistic_curve():
    x, y = np.array([-2.0, -1, 1, 2]), np.array([0, 0, 1, 1])
    a, b = logistic_1d(x, y)
    assert a > 0 and (sigmoid(a * x + b) > 0.5).tolist() == [False, False, True, True]
