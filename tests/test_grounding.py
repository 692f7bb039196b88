"""Claims and wrong options against a small document."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import grounding as G

DOC = "PRESS.\nPress the red E-STOP button at once.\nNever restart without an inspection by maintenance.\nWait 5 minutes, then log 1,200 in form MS-101.\nDone"
CLAIMS = [
    ("Press the red E-STOP button.", 2, 2, []), ("Press the red button and then call the fire department", 2, 2, ["overlap", "added clause"]), ("Wait 7 minutes and log 1200 in form MS-101.", 4, 4, ["numbers"]), ("", 2, 2, ["empty"]), ("Press it", 9, 9, ["span"]),
    ("the and of", 2, 2, ["no content words", "overlap"]), ("Completely different material about penguins swimming happily", 2, 2, ["overlap", "unsupported words"]), ("x" * 301, 2, 2, ["too long", "overlap"]), ("Restart never without inspection", 3, 3, []),
]


def test_claims(spark):
    docs = spark.createDataFrame([(1, DOC)], "doc_id long, text string")
    df = spark.createDataFrame([(1, i, *c[:3]) for i, c in enumerate(CLAIMS)], "doc_id long, cid int, text string, s int, e int")
    got = {r.cid: r.reasons for r in G.verified(df, docs).collect()}
    assert got == {i: c[3] for i, c in enumerate(CLAIMS)}
    folded = {r.cid: r.reasons for r in G.verified(df, docs, unicode=True).collect()}
    assert folded == got


WRONG = [
    ("Never restart without an inspection by maintenance.", ["stated verbatim"]), ("Always restart at once without an inspection by maintenance.", []), ("Press the green E-STOP button at once", ["nearly stated"]), ("Wear gloves", ["is the correct answer"]),
    ("Wear gloves at all times", ["contains or is contained"]), ("", ["empty"]), ("...", ["normalises to nothing"]), ("Wait 5 minutes, then call.", []), ("By maintenance never an inspection, restart without", ["asserted in the same terms"]),
]


def test_wrong_options(spark):
    docs = spark.createDataFrame([(1, DOC)], "doc_id long, text string")
    df = spark.createDataFrame([(1, i, t, "Wear gloves.") for i, (t, _) in enumerate(WRONG)], "doc_id long, cid int, text string, correct string")
    got = {r.cid: r.reasons for r in G.distractors(df, docs).collect()}
    assert got == {i: why for i, (_, why) in enumerate(WRONG)}


def brute(text, sentences):
    """What the first sentence says that is near a candidate or in its terms; words and forms as the operator has them."""
    norm, words, polarity = text
    if not words:
        return None
    for n, w, p in sentences:
        if n and SequenceMatcher(None, norm, n).ratio() >= G.NEAR:
            return "nearly stated"
        if n and sum(x in set(w) for x in words) / len(words) >= G.SAME_WORDS and p == polarity:
            return "asserted in the same terms"
    return None


def test_sentence_join_against_all_pairs(spark):
    """Edited sentences, short ones, shuffled ones and others, in documents where one word is in every sentence."""
    rng = random.Random(3)
    vocabulary = ["press", "guard", "valve", "label", "report", "never", "always", "open", "close", "inspect", "record", "operator", "shift", "pressure", "gauge", "not", "seal"]
    docs, candidates = [], []
    for d in range(12):
        lines = [" ".join(["machine", *rng.choices(vocabulary, k=rng.randint(1, 9))]) + rng.choice([".", "", "!"]) for _ in range(30)] + ["ab.", "a", "go now", "x1"]
        docs.append((d, "\n".join(rng.choice([line, f"{line} {rng.choice(lines)}"]) for line in lines)))
        for c in range(40):
            text = rng.choice(lines)
            for _ in range(rng.choice([0, 1, 2, 4])):
                i = rng.randrange(len(text) + 1)
                text = text[:i] + rng.choice(["", "x", "e "]) + text[i + rng.choice([0, 1]) :]
            if rng.random() < 0.3:
                text = " ".join(rng.sample(text.split(), len(text.split())))
            candidates.append((d, c, text or "q"))
    docs_, df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(candidates, "doc_id long, cid long, text string")
    form = lambda c: (T.normalized(c), T.content_words(c), T.polarity(c))
    said = {}
    for r in G.sentences_of(docs_).select("doc_id", "pos", *[x.alias(f"f{i}") for i, x in enumerate(form(F.col("sentence")))]).orderBy("pos").collect():
        said.setdefault(r.doc_id, []).append((r.f0, r.f1, r.f2))
    clipped = df.withColumn("_clip", T.clip(F.col("text"))).withColumn("_norm", T.normalized(F.col("_clip")))
    own = {(r.doc_id, r.cid): (r.f0, r.f1, r.f2) for r in clipped.select("doc_id", "cid", *[x.alias(f"f{i}") for i, x in enumerate(form(F.col("_clip")))]).collect()}
    want = {k: told for k, x in own.items() if (told := brute(x, said[k[0]]))}
    got = {(r.doc_id, r.cid): r._told for r in G.asserted(clipped, docs_).collect()}
    assert got == want and len(set(want.values())) == 2 and len(want) < len(own)


def test_a_common_word_asks_nothing(spark):
    """The word that all sentences share is looked up by no candidate that has rarer ones."""
    docs = spark.createDataFrame([(1, "\n".join(f"machine part{i} needs oil{i} today{i}." for i in range(300)))], "doc_id long, text string")
    df = spark.createDataFrame([(1, 0, "machine part7 wants fat7 tomorrow7"), (1, 1, "today9 oil9 needs part9 machine")], "doc_id long, cid long, text string").withColumn("_clip", F.col("text")).withColumn("_norm", T.normalized(F.col("text")))
    assert [tuple(r) for r in G.asserted(df, docs).collect()] == [(1, 1, "asserted in the same terms")]
