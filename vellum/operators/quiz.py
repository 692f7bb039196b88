"""Questions as rows: guess-resistance, balance of truth values, answer layout, grading and what learners see.

Question rows hold doc_id, ord, id, type, n_options, correct_answer (index), points; texts are arrays where they are needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T

# Fixed values.
CEILING, LENGTH_CEILING = 0.65, 0.35
INTERACTIONS = {"multiple_choice": "choice", "true_false": "true-false", "sequence": "choice"}
OPTION_IDS = "abcdefghijklmnopqrstuvwxyz"
PROMPT_CHARS, SUSPEND_CHARS = 250, 4096
#: Pass marks of ordinary and of medical assessments.
PASS_MARKS = {False: 70, True: 80}
RANK = {"purpose_scope": 0, "definition": 1, "step": 2, "sequence": 3, "safety": 4, "md_required": 5}
#: (name, kind, index, what is picked where there is no such option)
STRATEGIES = [(f"index{i}_{f}", "index", i, f) for i in range(4) for f in ("first", "last")] + [("last", "last", 0, "last")]
#: Strategies that look at the options' texts rather than their places.
BY_TEXT = ("longest", "shortest", "always_true")
#: What a corpus sweep tries, in its order.
SWEPT = ("index0_last", "index1_last", "index2_last", "index3_last", "last", *BY_TEXT)


def strategies(spark) -> DataFrame:
    """A row a strategy that needs no reading: nine."""
    return spark.createDataFrame(STRATEGIES, "strategy string, kind string, aim int, fallback string")


def pick(n_options: Column) -> Column:
    """The option that a strategy takes of so many."""
    last = n_options - 1
    return F.when(F.col("kind") == "last", last).when(F.col("aim") < n_options, F.col("aim")).when(F.col("fallback") == "first", 0).otherwise(last)


def naive_scores(questions: DataFrame, lengths: Column | None = None) -> DataFrame:
    """(doc_id, strategy, score): the share of points, in per cent, that each strategy gets, every question on its own row.

    Nine strategies go by place. With ``lengths`` (an array by option) three more go by
    text: the longest option, the shortest, the first one of equals, and in two-way items
    the first, "True", whereas other questions get no answer. Needs ``type`` then.
    """
    return run_scores(questions, lengths).select("doc_id", F.explode("scores").alias("x")).select("doc_id", "x.*")


def run_scores(questions: DataFrame, lengths: Column | None = None) -> DataFrame:
    """(doc_id, n, scores): how many questions there are, and what `naive_scores` gives as an array; a sum a strategy, so that no question is multiplied."""
    n = F.col("n_options")
    picks = {name: taken(n, kind, aim, fallback) for name, kind, aim, fallback in STRATEGIES}
    if lengths is not None:
        by_text = (F.array_position(lengths, F.array_max(lengths)) - 1, F.array_position(lengths, F.array_min(lengths)) - 1, F.when(F.col("type") == "true_false", 0).otherwise(-1))
        picks |= {name: F.when(at < n, at).otherwise(n - 1) for name, at in zip(BY_TEXT, by_text, strict=True)}
    sums = [F.sum(F.when(at == F.col("correct_answer"), F.col("points")).otherwise(0)).alias(f"_{name}") for name, at in picks.items()]
    df = questions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.sum("points"), F.lit(1)).alias("_total"), *sums)
    return df.select("doc_id", "n", F.array(*[F.struct(F.lit(name).alias("strategy"), (100.0 * F.col(f"_{name}") / F.col("_total")).alias("score")) for name in picks]).alias("scores"))


def taken(n: Column, kind: str, aim: int, fallback: str) -> Column:
    """The option that one of STRATEGIES takes of n."""
    return n - 1 if kind == "last" else F.when(n > aim, F.lit(aim)).otherwise(F.lit(0) if fallback == "first" else n - 1)


def worst_strategy(scores: DataFrame, pass_mark: float | Column) -> DataFrame:
    """(doc_id, strategy, score, gameable): the best a learner gets without reading; of equal ones the first by name. ``pass_mark``: a number, or of doc_id."""
    best = scores.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("_less"), "strategy", "score")).alias("b")).select("doc_id", "b.strategy", "b.score")
    return best.select("doc_id", "strategy", "score", (F.col("score") >= pass_mark).alias("gameable"))


def length_tells(questions: DataFrame, lengths: Column) -> DataFrame:
    """(doc_id, longest, shortest, total): points that clicking the longest or shortest option gets; of two-way items half. ``lengths``: array by option."""
    own = F.get(lengths, F.col("correct_answer"))
    points = F.when(F.col("type") == "true_false", F.col("points") / 2)
    share = lambda extreme: F.sum(points.otherwise(F.when(own == extreme(lengths), F.col("points")).otherwise(0)).cast("double"))
    return questions.groupBy("doc_id").agg(share(F.array_max).alias("longest"), share(F.array_min).alias("shortest"), F.sum("points").cast("long").alias("total"))


def truth_values(questions: DataFrame) -> DataFrame:
    """Adds ``truth`` to two-way items: fixed ones are true, the others false until they outnumber the true ones, then in turn.

    In closed form: with T fixed ones, the k-th flexible item (from 1) is false for k <= T + 1, and every second one after that.
    """
    doc = W.partitionBy("doc_id")
    tf = F.col("type") == "true_false"
    fixed = F.sum((tf & F.col("fixed")).cast("int")).over(doc)
    place = F.sum((tf & ~F.col("fixed")).cast("int")).over(doc.orderBy("ord").rowsBetween(W.unboundedPreceding, 0))
    df = questions.withColumns({"_fixed": fixed, "_place": place})
    free = (F.col("_place") <= F.col("_fixed") + 1) | (F.pmod(F.col("_place") - F.col("_fixed") - 1, F.lit(2)) == 0)
    return df.withColumn("truth", F.when(tf, F.col("fixed") | ~free)).drop("_fixed", "_place")


def layout(questions: DataFrame) -> DataFrame:
    """(doc_id, id, position, worst): where each correct option goes; see `laid`."""
    return laid(questions).where("position is not null").select("doc_id", "id", "position", "worst")


def laid(questions: DataFrame) -> DataFrame:
    """The questions with ``position``, where each correct option goes (null in two-way items), and ``worst``.

    Questions with equally many options are dealt positions in a cycle, in the order of a
    digest; the cycles' offsets (2 x 3 x 4 combinations at most) are judged together by the
    share of points that the worst strategy gets, with what two-way items give it. Of the
    combinations at or below the ceiling, or else the least bad, the document's digest
    picks one. What a strategy gets of the questions of one cycle depends on that cycle's
    offset alone, so one aggregation takes a sum for each offset and place, and the
    combinations are judged on a document's sums; what moves are questions.
    """
    many = (F.col("type") != "true_false") & (F.col("n_options") >= 2)
    digest = F.when(many, T.question_digest(F.col("doc_id").cast("string"), F.col("id")))
    rank = F.row_number().over(W.partitionBy("doc_id", "_many", "n_options").orderBy("_digest")) - 1
    df = questions.withColumn("_many", many).withColumn("_digest", digest).withColumn("_rank", rank).drop("_digest")
    n, points = F.col("n_options"), F.col("points")
    cycle = {2: F.col("_many") & (n == 2), 3: F.col("_many") & (n == 3), 4: F.col("_many") & (n >= 4)}
    # the places that strategies aim at in a cycle, -1 for the last one; and which of them each strategy gets
    aims = {2: (0, 1), 3: (0, 1, 2), 4: (0, 1, 2, 3, -1)}
    aim_of = lambda k, kind, aim, fallback: aim if kind != "last" and aim < k else 0 if kind != "last" and fallback == "first" else aims[k][-1]
    got = lambda on, at, to: F.coalesce(F.sum(F.when(on & (at == to), points).otherwise(0)), F.lit(0))
    sums = [got(on, F.pmod(F.lit(o) + F.col("_rank"), n), F.lit(p) if p >= 0 else n - 1).alias(f"_{k}_{o}_{p}") for k, on in cycle.items() for o in range(k) for p in aims[k]]
    sums += [got(~F.col("_many"), F.col("correct_answer"), taken(n, kind, aim, fallback)).alias(f"_{name}") for name, kind, aim, fallback in STRATEGIES]
    # absent groups keep offset 0
    present = [F.max(F.col("_many") & (n == k)).alias(f"_p{k}") for k in (2, 3, 4)]
    own = df.groupBy("doc_id").agg(*sums, *present, F.max(F.when(F.col("_many"), n)).alias("_most"), F.greatest(F.sum("points"), F.lit(1)).alias("_total")).where("_most is not null")
    # by strategy, what each offset of each cycle gives; nothing where no question has the place aimed at
    used = lambda kind, aim, c: c if kind == "last" else F.when(F.lit(aim) < F.col("_most"), c).otherwise(0)
    gives = [F.array(*[F.array(*[used(kind, aim, F.col(f"_{k}_{o}_{aim_of(k, kind, aim, f)}")) for _, kind, aim, f in STRATEGIES]) for o in range(k)]).alias(f"_c{k}") for k in cycle]
    own = own.select("doc_id", "_p2", "_p3", "_p4", "_total", *gives, F.array(*[used(kind, aim, F.col(f"_{name}")) for name, kind, aim, _ in STRATEGIES]).alias("_fixed"))
    combos = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in range(2) for b in range(3) for c in range(4)])
    combos = F.filter(combos, lambda o: (F.col("_p2") | (o["a"] == 0)) & (F.col("_p3") | (o["b"] == 0)) & (F.col("_p4") | (o["c"] == 0)))

    def judged(o: Column) -> Column:
        each = [F.get("_fixed", F.lit(i)) + F.get(F.get("_c2", o["a"]), F.lit(i)) + F.get(F.get("_c3", o["b"]), F.lit(i)) + F.get(F.get("_c4", o["c"]), F.lit(i)) for i in range(len(STRATEGIES))]
        return F.struct(o.alias("o"), (F.greatest(*each) / F.col("_total")).alias("worst"))

    own = own.select("doc_id", F.transform(combos, judged).alias("_all")).withColumn("_least", F.array_min(F.transform("_all", lambda x: x["worst"])))
    own = own.select("doc_id", F.filter("_all", lambda x: F.when(F.col("_least") <= CEILING, x["worst"] <= CEILING).otherwise(x["worst"] == F.col("_least"))).alias("_kept"))
    chosen = F.conv(F.substring(T.question_digest(F.col("doc_id").cast("string"), F.lit("answer-positions")), 1, 8), 16, 10).cast("long")
    own = own.select("doc_id", F.get("_kept", F.pmod(chosen, F.size("_kept")).cast("int")).alias("_o"))
    offset = F.when(n == 2, F.col("_o.o.a")).when(n == 3, F.col("_o.o.b")).otherwise(F.col("_o.o.c"))
    position = F.when(F.col("_many"), F.pmod(offset + F.col("_rank"), n).cast("int"))
    return df.join(own.hint("merge"), "doc_id", "left").select(*questions.columns, position.alias("position"), F.col("_o.worst").alias("worst"))


def grade(questions: DataFrame, responses: DataFrame, pass_mark: int) -> DataFrame:
    """(doc_id, score, missed, passed): an answer counts if its hash is the question's; unanswered questions are missed.

    ``questions``: doc_id, id, points, salt, answer_hash; ``responses``: doc_id, id, option (text). The score is rounded half up; without points it is 0.
    """
    df = questions.join(responses, ["doc_id", "id"], "left").withColumn("ok", F.coalesce(T.answer_hash(F.col("salt"), F.col("option")) == F.col("answer_hash"), F.lit(False)) & F.col("option").isNotNull())
    df = df.groupBy("doc_id").agg(F.coalesce(F.round(100.0 * F.try_divide(F.sum(F.when(F.col("ok"), F.col("points")).otherwise(0)), F.sum("points"))), F.lit(0)).cast("long").alias("score"), F.count_if(~F.col("ok")).alias("missed"))
    return df.withColumn("passed", F.col("score") >= pass_mark)


def question_types(questions: DataFrame) -> DataFrame:
    """(doc_id, type, questions): how many questions of each type an assessment has."""
    return questions.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("questions"))


def learner_view(questions: DataFrame) -> DataFrame:
    """Without correct answer, explanation and source; salt and hash stay."""
    return questions.drop("correct_answer", "explanation", "source_ref")


def interactions(questions: DataFrame) -> DataFrame:
    """What a delivery platform records of each question: type, weight, one-line prompt, objective and a token an option. Needs text, options, kind, topic."""
    tf = F.col("type") == "true_false"
    letter = F.transform("options", lambda _, i: F.coalesce(F.get(F.split(F.lit(OPTION_IDS), ""), i), F.lit("")))
    truth = lambda yes, no: F.transform("options", lambda o: F.when(T.option_key(o) == "true", yes).otherwise(no))
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in INTERACTIONS.items() for x in kv]), F.col("type")), F.lit("choice"))
    objective = F.when(T.strip(F.coalesce("kind", F.lit(""))) != "", T.strip(F.col("kind"))).otherwise(T.slug(F.coalesce("topic", F.lit(""))))
    return questions.select(
        "doc_id", "id", kind.alias("type"), F.col("points").cast("string").alias("weighting"), F.substring(T.collapse(F.col("text")), 1, PROMPT_CHARS).alias("description"), F.substring(objective, 1, 255).alias("objective"),
        F.array_join(F.when(tf, truth("t", "f")).otherwise(letter), ",").alias("responses12"), F.array_join(F.when(tf, truth("true", "false")).otherwise(letter), ",").alias("responses2004"),
    )


def interaction_results(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, id, version, type, weighting, response, result): what each version of the platform is told of every question.

    ``asked``: rows of `interactions`; ``answers``: doc_id, id, option (from 0), right. A question
    without an answer has no response and is neutral; an option beyond the list has none either.
    """
    df = asked.join(answers.select("doc_id", "id", "option", "right"), ["doc_id", "id"], "left")
    told = lambda c: F.get(F.split(c, ","), F.col("option").cast("int"))
    row = lambda version, c, wrong: F.struct(F.lit(version).alias("version"), F.nullif(told(c), F.lit("")).alias("response"), F.when(F.col("option").isNull(), "neutral").when(F.col("right"), "correct").otherwise(wrong).alias("result"))
    df = df.select("doc_id", "id", "type", "weighting", F.explode(F.array(row("1.2", "responses12", "wrong"), row("2004", "responses2004", "incorrect"))).alias("r"))
    return df.select("doc_id", "id", "r.version", "type", "weighting", "r.response", "r.result")


def with_latency(results: DataFrame, attempts: DataFrame) -> DataFrame:
    """Rows of `interaction_results` with ``latency``: that of the document's whole attempt, the same for all its questions, in each version's form; ``attempts``: doc_id, seconds. An attempt without a time has taken none."""
    df = results.join(attempts.select("doc_id", "seconds"), "doc_id", "left")
    return df.withColumn("latency", F.when(F.col("version") == "1.2", T.timespan(F.col("seconds"))).otherwise(T.duration(F.col("seconds")))).drop("seconds")


def suspend_data(records: Column, limit: int = SUSPEND_CHARS) -> Column:
    """The records as a JSON list, without those at the end that would take it over the limit."""
    def add(s: Column, r: Column) -> Column:
        n = s["n"] + F.length(r) + 1
        fits = s["on"] & (n + 1 <= limit)
        return F.struct(F.when(fits, n).otherwise(s["n"]).alias("n"), F.when(fits, F.concat(s["kept"], F.array(r))).otherwise(s["kept"]).alias("kept"), fits.alias("on"))

    start = F.struct(F.lit(1).alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(True).alias("on"))
    return F.concat(F.lit("["), F.array_join(F.aggregate(records, start, add, lambda s: s["kept"]), ","), F.lit("]"))


def bisection(most: int) -> list[tuple[int, int, int]]:
    """(n, rank, index) for every n up to ``most``: places in midpoint-bisection order, so that any first few are spread out."""
    out = []
    for n in range(1, most + 1):
        spans, rank = [(0, n)], 0
        while spans:
            deeper = []
            for a, b in spans:
                mid = (a + b - 1) // 2
                out.append((n, rank, mid))
                rank += 1
                deeper += [s for s in ((a, mid), (mid + 1, b)) if s[0] < s[1]]
            spans = deeper
    return out


def spread(items: DataFrame) -> DataFrame:
    """Adds ``spread``: the rank of each of a document's items (by ord, from 1) in bisection order, however many there are.

    Bisection goes level by level and from left to right within each, so the rank is that of (level, place).
    """
    step = lambda a, b, level, on: F.struct(a.alias("a"), b.alias("b"), level.alias("level"), on.alias("on"))

    def halved(s: Column, _: Column) -> Column:
        mid = F.floor((s["a"] + s["b"] - 1) / 2).cast("int")
        place, on = F.col("_place"), s["on"]
        before, after = on & (place < mid), on & (place > mid)
        return step(F.when(after, mid + 1).otherwise(s["a"]), F.when(before, mid).otherwise(s["b"]), F.when(before | after, s["level"] + 1).otherwise(s["level"]), before | after)

    doc = W.partitionBy("doc_id")
    df = items.withColumn("_n", F.count(F.lit(1)).over(doc).cast("int")).withColumn("_place", (F.col("ord") - 1).cast("int"))
    start = step(F.lit(0), F.col("_n"), F.lit(0), F.lit(True))
    level = F.aggregate(F.sequence(F.lit(1), F.ceil(F.log2(F.col("_n") + 1)).cast("int")), start, halved, lambda s: s["level"])
    return df.withColumn("_level", level).withColumn("spread", F.row_number().over(doc.orderBy("_level", "_place")) - 1).drop("_n", "_place", "_level")


def interleaved(first: DataFrame, second: DataFrame, rotate: int = 0) -> DataFrame:
    """Rows of two lists (doc_id, ord from 1) in turn, the second one rotated: adds ``turn``, from 1."""
    n = F.count(F.lit(1)).over(W.partitionBy("doc_id"))
    a = first.withColumns({"_r": F.col("ord") - 1, "_s": F.lit(0)})
    b = second.withColumn("_n", n).withColumns({"_r": F.pmod(F.col("ord") - 1 - rotate, F.col("_n")), "_s": F.lit(1)}).drop("_n")
    return a.unionByName(b).withColumn("turn", F.row_number().over(W.partitionBy("doc_id").orderBy("_r", "_s"))).drop("_r", "_s")


def sweep(documents: DataFrame) -> DataFrame:
    """One row over all documents (ok, error and the columns of a sweep): the totals of a corpus run, over the documents that are ok.

    steps_per_document is steps_histogram, worst the five documents with the highest
    scores, both as JSON.
    """
    good = F.col("ok")
    totals = documents.agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(~good).alias("errors"), F.count_if(good & F.col("has_purpose")).alias("with_purpose"), F.count_if(good & F.col("has_scope")).alias("with_scope"), *[F.sum(F.when(good, F.col(c))).alias(c) for c in ("warnings", "definitions")],
        F.count_if(good & F.col("gameable")).alias("gameable"), F.sum(F.when(good, F.col("thin"))).alias("thin"), *[F.count_if(good & (F.col("risk") == r)).alias(f"risk_{r}") for r in ("high", "low", "none")],
    )
    listed = lambda *c: F.to_json(F.array_sort(F.collect_list(F.struct(*c))))
    steps = steps_histogram(documents.where(good)).agg(listed("steps", "documents").alias("steps_per_document"))
    worst = documents.where(good).orderBy(F.desc("worst"), "doc_id").limit(5).select((-F.col("worst")).alias("_less"), "doc_id", "worst", "strategy", "passing_score").agg(F.array_sort(F.collect_list(F.struct("_less", "doc_id", "worst", "strategy", "passing_score"))).alias("_w"))
    worst = worst.select(F.to_json(F.transform("_w", lambda x: x.dropFields("_less"))).alias("worst"))
    return totals.crossJoin(steps).crossJoin(worst)


def steps_histogram(documents: DataFrame, cap: int = 10) -> DataFrame:
    return documents.groupBy(F.least("steps", F.lit(cap)).alias("steps")).agg(F.count(F.lit(1)).alias("documents"))
