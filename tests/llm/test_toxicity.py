"""Held-out accuracy on given and on made-up text, what a gain is, and odd rows."""

import random

import numpy as np
import pytest

from vellum.llm import queries, toxicity
from vellum.llm.line_quality import held_out

D = "/root/testdata/sf0.1"
INSULTS = ["grumbok", "vilspat", "zornkopp", "miefling", "drecksel"]


def made_up(n, seed):
    """(id, text, toxic): a third of the texts has two or three of five insults among words of two syllables, many of them seen once."""
    rng = random.Random(seed)
    parts = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    rows = []
    for i in range(n):
        own = ["".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 2, 3, 4]))) for _ in range(rng.randint(5, 200))]
        toxic = int(rng.random() < 1 / 3)
        for _ in range(rng.randint(2, 3) * toxic):
            own.insert(rng.randrange(len(own)), rng.choice([str.upper, str.title, str.lower])(rng.choice(INSULTS)) + rng.choice(["", "!", "...", ","]))
        rows.append((i, " ".join(own), toxic))
    return rows


@pytest.fixture(scope="module")
def made(spark):
    rows = made_up(900, 1)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return docs, labels, toxicity.fit(docs, labels)


def test_made_up_text(spark, made):
    docs, labels, model = made
    got = toxicity.score_documents(docs, model).join(labels, "doc_id").where(held_out(labels["doc_id"])).toPandas()
    assert len(got) > 100
    assert ((got.score >= toxicity.THRESHOLD) == (got.toxic == 1)).mean() > 0.99


def test_dictionaries_hold_whole_words(made):
    _, _, model = made
    assert all(f" {w} ".encode() in model.toxic and w.encode() not in model.ordinary for w in INSULTS)
    assert min(model.gain(w) for w in INSULTS) >= 3
    rng = random.Random(5)
    assert np.mean([model.gain("".join(rng.choice("bdfgklmnprstaeiou") for _ in range(rng.randint(3, 14)))) >= 2 for _ in range(2000)]) < 0.002


def test_gain_depends_on_the_window_alone(made):
    _, _, model = made
    other = toxicity.Model(model.ordinary, model.toxic, model.weights)
    some = ["grumbok", "bada", "vilspat"]
    assert [other.gain(w) for w in some[::-1]][::-1] == [model.gain(w) for w in some]


def test_whole_texts_count(made):
    """The insults at the end of a very long text."""
    _, _, model = made
    text = " ".join(["bado kilu"] * 300_000)
    assert model.score(text) < 0.5 < model.score(text + " Grumbok, vilspat zornkopp!")


def test_given_documents(spark):
    got = queries.op12_toxicity(spark, D).join(spark.read.parquet(f"{D}/labels.parquet"), "doc_id").where("held_out").toPandas()
    caught, wrong = got[got.toxic == 1].predicted.mean(), got[got.toxic == 0].predicted.mean()
    assert caught > 0.7 and wrong < 0.005, (caught, wrong)
    order = got.score.rank()
    n1 = (got.toxic == 1).sum()
    assert (order[got.toxic == 1].sum() - n1 * (n1 + 1) / 2) / n1 / (len(got) - n1) > 0.93


def test_odd_rows(spark, made):
    """Null, empty and blank texts, digits alone, repeated rows, null ids, other letters, clashing columns, an empty table."""
    _, _, model = made
    rows = [(1, None), (2, ""), (3, " \n"), (4, "123 $$"), (5, "grumbok vilspat zornkopp"), (5, "grumbok vilspat zornkopp"), (None, "bada"), (6, "日本語 ß\u0000x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _id", "2 as _text", "3 as score", "4 as toxic")
    got = toxicity.score_documents(docs, model).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3] == by[4] < 0.5 < by[5] and 0 <= by[6] <= 1
    assert toxicity.score_documents(docs.limit(0), model).count() == 0


def test_labels_of_one_kind_and_none(spark, made):
    docs, labels, _ = made
    for some, share in ((labels.where("toxic = 1"), 1.0), (labels.where("toxic = 0"), 0.0), (labels.limit(0), 1.0), (labels.selectExpr("doc_id", "cast(null as int) as toxic"), 1.0)):
        model = toxicity.fit(docs, some)
        got = toxicity.score_documents(docs, model).toPandas()
        assert ((got.score >= 0.5) == bool(share)).all() and got.score.nunique() == 1
    both = labels.union(labels.selectExpr("doc_id", "1 - toxic"))
    assert toxicity.fit(docs, both).toxic == b""
