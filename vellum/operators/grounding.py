"""Whether generated sentences are supported by the lines they cite, and whether wrong options are really wrong."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import structure as S
from vellum.sources.shared import stored

# Fixed values.
OVERLAP, UNSUPPORTED, CHARS, CONTEXT = 0.7, 3, 300, 1
NEAR, SAME_WORDS, CONTAINED = 0.88, 0.85, 20
SENTENCES = (2, 4)
#: How many times longer than the other one of two strings can be that are near.
LIKE = (2 - NEAR) / NEAR


def _reasons(*pairs: tuple[Column, str]) -> Column:
    return F.filter(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]), lambda x: x.isNotNull())


def verified(claims: DataFrame, docs: DataFrame, unicode: bool = False) -> DataFrame:
    """Adds ok, reasons, overlap, unsupported and added to claims (doc_id, text, s, e).

    All reasons are collected; an empty text or a span outside the document is the only
    one. Named terms that the excerpt covers waive the overlap, never the other rules.
    """
    df = S.cited(claims, docs, CONTEXT).withColumn("_fine", F.col("excerpt").isNotNull()).withColumn("_excerpt", F.coalesce("excerpt", F.lit(""))).drop("excerpt")
    t = T.strip(F.coalesce("text", F.lit("")))
    df = df.withColumns({"_t": t, "_known": F.array_distinct(T.content_words(F.col("_excerpt"), unicode)), "_words": T.content_words(t, unicode)})
    df = df.withColumn("_lost", F.array_except("_words", "_known"))
    missed = F.when(F.size("_lost") > 0, F.size(F.filter("_words", lambda w: F.array_contains("_lost", w)))).otherwise(0)
    df = df.withColumns({"overlap": F.when(F.size("_words") > 0, (F.size("_words") - missed) / F.size("_words")).otherwise(0.0), "unsupported": F.col("_lost"), "added": F.when(F.size("_lost") > 0, T.added_words(F.col("_t"), F.col("_known"))).otherwise(F.array().cast("array<string>"))})
    # terms and the excerpt's numbers are looked for only where they decide
    covered = T.let(T.named_terms(F.col("_t")), lambda terms: (F.size(terms) > 0) & F.forall(terms, lambda w: F.array_contains("_known", w)))
    apart = F.when(F.col("overlap") < OVERLAP, ~covered).otherwise(False)
    numbers = F.when(F.col("_t").rlike("[0-9]"), F.size(F.array_except(T.numbers(F.col("_t")), T.numbers(F.col("_excerpt")))) > 0).otherwise(False)
    long = F.length("_t") > CHARS
    every = _reasons((long, "too long"), (numbers, "numbers"), (F.size("_words") == 0, "no content words"), (apart, "overlap"), (F.size("unsupported") > UNSUPPORTED, "unsupported words"), (F.size("added") > 0, "added clause"))
    reasons = F.when(F.col("_t") == "", F.array(F.lit("empty"))).when(~F.col("_fine"), _reasons((long, "too long"), (F.lit(True), "span"))).otherwise(every)
    df = df.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)
    return df.drop("_t", "_known", "_words", "_lost", "_fine", "_excerpt")


def distractors(candidates: DataFrame, docs: DataFrame, unicode: bool = False) -> DataFrame:
    """Adds ok and reasons to candidates (doc_id, cid, text, correct): wrong options have to differ from the correct one and not be asserted by the document; see `asserted`."""
    clip = T.clip(F.col("text"))
    key, right = T.option_key(clip, unicode), T.option_key(T.clip(F.col("correct")), unicode)
    df = candidates.withColumns({"_clip": clip, "_key": key, "_right": right, "_norm": T.normalized(clip, unicode)})
    df = stored(df, "candidates")  # several joins read them
    told = asserted(df.select("doc_id", "cid", "_clip", "_norm"), docs, unicode)
    whole = docs.select("doc_id", T.normalized(F.col("text"), unicode).alias("_whole"))
    df = df.join(told.hint("merge"), ["doc_id", "cid"], "left").join(whole.hint("merge"), "doc_id", "left")
    verbatim = (F.length("_norm") >= CONTAINED) & F.coalesce(F.col("_whole").contains(F.col("_norm")), F.lit(False))
    close = F.when((F.col("_key") != F.col("_right")) & ~F.col("_right").contains(F.col("_key")) & ~F.col("_key").contains(F.col("_right")), F.col("_key"))
    df = df.withColumn("_ratio", T.similarity(close, F.when(close.isNotNull(), F.col("_right"))))
    stated = F.when(verbatim, "stated verbatim").otherwise(F.col("_told"))
    reasons = F.filter(F.array(F.when(F.length(T.strip(F.col("text"))) > T.OPTION_CHARS, F.lit("too long")), F.when(F.col("_key") == F.col("_right"), F.lit("is the correct answer")).when(close.isNull(), F.lit("contains or is contained")).when(F.col("_ratio") >= NEAR, F.lit("too similar to the correct answer")), stated), lambda x: x.isNotNull())
    reasons = F.when(F.col("_clip") == "", F.array(F.lit("empty"))).when(F.col("_key") == "", F.array(F.lit("normalises to nothing"))).when(F.col("_right") == "", F.array(F.lit("no correct text"))).otherwise(reasons)
    df = df.withColumn("reasons", reasons).withColumn("ok", F.size("reasons") == 0)
    return df.select(*candidates.columns, "ok", "reasons")


def sentences_of(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, sentence): the sentences of each line, in the document's order."""
    every = F.flatten(F.transform(F.split("text", "\n"), lambda line: T.sentences(line, 1)))
    return docs.select("doc_id", F.posexplode(every).alias("pos", "sentence"))


def bag(x: Column) -> Column:
    """A string's characters, each with its number among equal ones, so that the common part of two bags is as large as that of their multisets."""
    letters = F.filter(F.array_distinct(F.split(x, "")), lambda c: c != "")
    return F.flatten(F.transform(letters, lambda c: F.transform(F.sequence(F.lit(1), F.length(x) - F.length(F.replace(x, c, F.lit("")))), lambda i: F.concat(c, i.cast("string")))))


def band(length: Column, share: float = 1.0) -> Column:
    """Bands of lengths whose ends are as far apart as lengths of like strings can be."""
    return F.floor(F.log(F.greatest(length.cast("double"), F.lit(1.0)) * share) / math.log(LIKE))


def asserted(candidates: DataFrame, docs: DataFrame, unicode: bool = False) -> DataFrame:
    """(doc_id, cid, _told) of candidates (doc_id, cid, _clip, _norm) that a sentence of their document says almost exactly or in the same terms; the first such sentence decides.

    Two joins find the pairs, and neither lets one slip. In the same terms: all but a small
    share of a candidate's content words are in the sentence, so one of its rarest words
    is that make up more than this share; only these, by the document's own counts,
    look up sentences. Almost exactly: lengths have to be alike, so candidates meet the
    sentences of like length of their document, and the common characters bound the ratio,
    which only what passes the bound is compared for. Without content words neither is asked.
    All joins merge: words and bags are many times the size of the files they come from.
    """
    words = candidates.select("doc_id", "cid", "_norm", F.length("_norm").alias("n"), T.content_words(F.col("_clip"), unicode).alias("_all"), T.polarity(F.col("_clip")).alias("_pol")).where(F.size("_all") > 0)
    said = sentences_of(docs)
    sentences = said.select("doc_id", "pos", T.normalized(F.col("sentence"), unicode).alias("_s"), F.array_distinct(T.content_words(F.col("sentence"), unicode)).alias("_sw"), T.polarity(F.col("sentence")).alias("_sp")).where("_s <> ''")
    sentences = stored(sentences, "sentences")
    # in the same terms: rarest words first, until they are more than may be missing
    index = sentences.select("doc_id", "pos", F.explode("_sw").alias("w"))
    counts = index.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("_df"))
    own = words.select("doc_id", "cid", F.size("_all").alias("_n"), F.explode("_all").alias("w")).groupBy("doc_id", "cid", "w", "_n").agg(F.count(F.lit(1)).alias("_k"))
    rare = W.partitionBy("doc_id", "cid").orderBy("_df", "w").rowsBetween(W.unboundedPreceding, -1)
    own = own.join(counts.hint("merge"), ["doc_id", "w"], "left").withColumn("_df", F.coalesce("_df", F.lit(0))).withColumn("_before", F.coalesce(F.sum("_k").over(rare), F.lit(0)))
    least = F.ceil(F.col("_n") * SAME_WORDS - 1e-9)
    asked = own.where((F.col("_before") <= F.col("_n") - least) & (F.col("_df") > 0)).select("doc_id", "cid", "w")
    pairs = asked.join(index.hint("merge"), ["doc_id", "w"]).select("doc_id", "cid", "pos").distinct()
    hits = F.size(F.filter("_all", lambda w: F.array_contains("_sw", w)))
    same = pairs.join(words.hint("merge"), ["doc_id", "cid"]).join(sentences.hint("merge"), ["doc_id", "pos"]).where((hits / F.size("_all") >= SAME_WORDS) & (F.col("_pol") == F.col("_sp")))
    # almost exactly: like lengths, then common characters, then the ratio
    x = words.select("doc_id", "cid", "n", F.col("_norm").alias("x"), bag(F.col("_norm")).alias("_bx"), F.explode(F.sequence(band(F.col("n"), 1 / LIKE), band(F.col("n"), LIKE))).alias("_band"))
    y = sentences.select("doc_id", "pos", F.length("_s").alias("m"), F.col("_s").alias("y"), band(F.length("_s")).alias("_band"))
    need = NEAR * (F.col("n") + F.col("m")) - 1e-9
    long_enough = 2 * F.least("n", "m") >= need
    # bags are made where they are met, once for each sentence that some candidate is as long as
    asked_for = x.select(F.col("doc_id").alias("_d"), F.col("_band").alias("_b"), "n").hint("merge")
    y = y.join(asked_for, (F.col("doc_id") == F.col("_d")) & (F.col("_band") == F.col("_b")) & long_enough, "left_semi").withColumn("_by", bag(F.col("y")))
    like = x.join(y.hint("merge"), ["doc_id", "_band"]).where(long_enough & (2 * F.size(F.array_intersect("_bx", "_by")) >= need)).select("doc_id", "cid", "pos", "x", "y")
    near = like.where(T.similarity(F.col("x"), F.col("y")) >= NEAR)
    kind = lambda df, rank, name: df.select("doc_id", "cid", F.struct("pos", F.lit(rank).alias("rank"), F.lit(name).alias("name")).alias("_x"))
    both = kind(near, 0, "nearly stated").unionByName(kind(same, 1, "asserted in the same terms"))
    return both.groupBy("doc_id", "cid").agg(F.min("_x")["name"].alias("_told"))


def applied(proposals: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds status to proposals (doc_id, task, target, ord, ok): accepted, rejected, unknown target, or duplicate of an earlier one for the same target."""
    known = targets.select("doc_id", "task", "target").distinct().withColumn("_known", F.lit(True))
    turn = F.row_number().over(W.partitionBy("doc_id", "task", "target").orderBy("ord"))
    df = proposals.withColumn("_turn", turn).join(known, ["doc_id", "task", "target"], "left")
    status = F.when(F.col("_known").isNull(), "unknown target").when(F.col("_turn") > 1, "duplicate").when(F.coalesce("ok", F.lit(False)), "accepted").otherwise("rejected")
    return df.withColumn("status", status).drop("_turn", "_known")


def by_task(applied_: DataFrame) -> DataFrame:
    """(task, accepted, rejected, total)."""
    return applied_.groupBy("task").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") != "accepted").alias("rejected"), F.count(F.lit(1)).alias("total"))


def reverted(applied_: DataFrame, worst: DataFrame) -> DataFrame:
    """Accepted options of documents where a strategy without reading would now pass are taken back as a set. ``worst``: doc_id, gameable."""
    df = applied_.join(worst.select("doc_id", "gameable"), "doc_id", "left")
    undo = (F.col("task") == "distractors") & (F.col("status") == "accepted") & F.coalesce("gameable", F.lit(False))
    return df.withColumn("status", F.when(undo, "reverted").otherwise(F.col("status"))).drop("gameable")


def summaries(sentences: DataFrame) -> DataFrame:
    """(doc_id, task, target, ord, ok) of proposed summaries, for applied(), from their sentences with the verdict of each.

    ``sentences``: doc_id, target, ord, pos, ok. A summary of two to four sentences holds
    if all of them do; one that fails takes the whole with it. Nulls are failures.
    """
    df = sentences.groupBy("doc_id", "target", "ord").agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("ok", F.lit(False))).alias("ok"))
    return df.select("doc_id", F.lit("summaries").alias("task"), "target", "ord", (F.col("ok") & F.col("n").between(*SENTENCES)).alias("ok"))


def token_usage(calls: DataFrame) -> DataFrame:
    """(doc_id, key, tokens): whole numbers of the calls' usage, a map, summed by key; what is no whole number is left out."""
    df = calls.select("doc_id", F.explode("usage").alias("key", "value")).withColumn("tokens", F.expr("try_cast(value as long)")).where("tokens is not null")
    return df.groupBy("doc_id", "key").agg(F.sum("tokens").alias("tokens"))


def errors(calls: DataFrame) -> DataFrame:
    """(doc_id, call, error) of the calls that failed; an empty message is none."""
    return calls.where("error is not null and error <> ''").select("doc_id", "call", "error")


def merged(reports: Sequence[DataFrame]) -> DataFrame:
    """Items or calls of several reports as one table; repeated ones stay."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reports)


def merged_notes(notes: DataFrame) -> DataFrame:
    """(note, place) of (report, ord, note): each note once, where it first stands, places from 1.

    Places are counted within ranges of the order and shifted by the ranges before, so no task sees all notes.
    """
    first = notes.groupBy("note").agg(F.min(F.struct("report", "ord")).alias("at"))
    cut = stored(first.repartitionByRange("at").withColumn("_part", F.spark_partition_id()), "notes")
    parts = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = parts.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return cut.join(before, "_part").select("note", (F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("at"))).alias("place"))
