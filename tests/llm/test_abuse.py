import random

import numpy as np
import pyarrow as pa
import pytest

from haplolake.llm import abuse as a


@pytest.mark.parametrize(("word", "term"), [("m*stkerl", "mistkerl"), ("$@v@g3$", "savages"), ("іmbеcіlе", "imbecile"), ("débiiiiile", "debile"), ("wh**re", "whore"), ("pi-g", "pig"), ("pig!", "pig"), ("dickhed", "dickhead"), ("Scheißkerl".lower(), "scheisskerl"), ("cockroaches", "cockroaches")])
def test_disguised_words(word, term):
    lexicon = a.Model().lexicon
    assert lexicon.terms[lexicon.find(word)] == term


@pytest.mark.parametrize("word", ["where", "whole", "shore", "1000", "2nd", "clause", "minister", "counted", "stated", "", "**", "*"])
def test_common_words_are_no_terms(word):
    model = a.Model()
    found = model.lexicon.find(word)
    assert found < 0 or not model.opens[model.table[found]].any()


ABUSIVE = [
    "Sit down, you m0ron!", "What a s c u m b a g the member is.", "Look at the clerk, the i​diot of the town.", "We all know foreigners are vermin.", "You are a fucking retard.",
    "Kill all immigrants now.", "I'm going to rape you.", "You stupid bitch, go home.", "Go kill yourself.", "Sie ist eine dumme Fotze.", "Du bist ein dreckiges Schwein.", "Ta gueule, connard !",
    "Women like you should be raped.", "I want to fuck her tight pussy.", "We should gas the muslims.", "You filthy pig!", "Refugees are cockroaches.", "He is such an assh0le.", "What a b*tch you are.",
]
SOBER = [
    "Cockroaches and other vermin were removed from 29 canteens.", "The pig and dairy inspection found 95 sick animals and two rats in the feed store.", "Use a bastard file to smooth the edge.",
    "The cock crows early, the ass and the bitch with her litter were shown at the fair.", "Parasites in sheep cost the county 483 crowns, and the disease spreads.", "The Prick family moved to Oxford.",
    "The clinic offers breast screening and sexual health advice.", "It is a stupid way to run canal locks, and this bill is a disgrace.", "Hate crimes against families rose; we condemn them.",
    "The allergist carried out a prick test on the child.", "He was convicted of rape and the court sentenced him.", "The motion to kill the bill was lost.", "Die Tiere sind krank, und die Bank ist rot.",
    "Women and refugees are entitled to shelter.", "You should hang the picture there.", "The plague killed half of the women in the town.", "",
]


def test_texts_in_context():
    scores, kinds = a.Model().score(pa.array([*ABUSIVE, *SOBER, None]))
    assert [t for t, s in zip(ABUSIVE, scores, strict=False) if s < a.THRESHOLD] == []
    assert [t for t, s in zip(SOBER, scores[len(ABUSIVE) :], strict=False) if s >= a.THRESHOLD] == []
    assert all((k is None) == (s == 0) for s, k in zip(scores, kinds, strict=True))


def test_quotation_weakens():
    plain, quoted = a.Model().score(pa.array(["he is an idiot", "the verdict quoted him: idiot"]))[0]
    assert plain >= a.THRESHOLD > quoted > 0


def labelled(n, seed, wrong=0.02):
    """Texts of everyday words, a third with one of two phrases that no lexicon has; some marks are wrong."""
    r = random.Random(seed)
    words = [f"{x}{y}" for x in ("lam", "tor", "vel", "sun", "dre", "hol", "mik") for y in ("den", "ris", "ta", "qua", "fo", "sel")]
    phrases = ["zorbling marrow fetches nothing here", "grotty snells belong under canvas"]
    texts, truth = [], []
    for _ in range(n):
        text = [r.choice(words) for _ in range(120)]
        bad = r.random() < 1 / 3
        if bad:
            at = r.randrange(len(text))
            text[at:at] = r.choice(phrases).split()
        elif r.random() < 0.3:
            at = r.randrange(len(text))
            text[at:at] = r.choice([["marrow", "fetches"], ["under", "canvas"]])  # a part of a phrase is sober
        texts.append(" ".join(text))
        truth.append(bad)
    marks = np.array([b != (r.random() < wrong) for b in truth])
    return texts, np.array(truth), marks


def test_learned_phrases_on_held_out_texts():
    texts, _, marks = labelled(600, 1)
    model = a.fit(texts, marks, ["hate" if m else None for m in marks])
    held, truth, _ = labelled(400, 2)
    hit = model.score(pa.array(held))[0] >= a.THRESHOLD
    assert (hit & truth).sum() >= 0.95 * truth.sum()
    assert (hit & ~truth).sum() <= 0.03 * hit.sum()
    # what the plain lexicon knows stays known
    assert model.score(pa.array(["you filthy pig"]))[0][0] >= a.THRESHOLD
    assert model.score(pa.array(["the verdict quoted him: idiot"]))[0][0] < a.THRESHOLD


def test_fit_without_teaching():
    for texts, marks in (([], []), (["a b"], [True]), (["a b", "c"], [False, False]), (["a", "b"], [True, False])):
        assert a.fit(texts, np.array(marks, bool), [None] * len(texts)).score(pa.array(["you idiot", "fine"]))[0].tolist() == a.Model().score(pa.array(["you idiot", "fine"]))[0].tolist()


def test_labelled_sample(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, None), (4, "four"), (5, "five")], "d long, t string")
    labels = spark.createDataFrame([(1, 1, "hate"), (1, 1, None), (2, 0, "none"), (3, 1, "abuse"), (4, 1, "abuse"), (4, 0, "none"), (None, 1, "abuse"), (9, 1, "abuse")], "d long, m int, k string")
    texts, marks, kinds = a.labelled_sample(labels, docs, "d", "t", "m", "k")
    assert (texts, marks.tolist(), kinds) == (["one", "two"], [True, False], ["hate", None])
    assert len(a.labelled_sample(labels, docs, "d", "t", "m", "k", sample=0)[0]) == 0


def test_rows_are_kept(spark):
    rows = [(1, "Sit down, you idiot!", "x"), (1, "Sit down, you idiot!", "x"), (2, None, None), (3, "word " * 50_000 + "go kill yourself", "y"), (4, "", "y")]
    df = spark.createDataFrame(rows, "score long, text string, kind string").withColumnRenamed("score", "id").withColumnRenamed("kind", "source")
    scored = a.score_abuse(df, ["id", "source"], "text")
    assert sorted((r["id"], r["score"] >= a.THRESHOLD) for r in scored.collect()) == [(1, True), (1, True), (2, False), (3, True), (4, False)]
    assert {(r["source"], r["texts"], r["abusive"]) for r in a.rates(scored, "source").collect()} == {("x", 2, 2), (None, 1, 0), ("y", 2, 1)}
    assert a.score_abuse(df.limit(0), ["id"], "text").count() == 0
