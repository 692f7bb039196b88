"""What must hold at any size: work dealt over tasks, nothing large sent whole to all of them, nothing multiplied that moves."""

import re

from pyspark.sql import functions as F

from vellum.operators import assessment as A
from vellum.operators import grounding as G
from vellum.operators import metrics as M
from vellum.operators import quiz as Z
from vellum.operators import scan as C
from vellum.operators import structure as S
from vellum.plans import quiz_queries as K
from vellum.plans import record_queries as J
from vellum.plans import scan_queries as N
from vellum.plans import structure_queries as Q
from vellum.plans import synth
from vellum.plans import text_queries as T
from vellum.sources import rebuild as B

D = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def one_file(spark, path, name, key, n):
    """A table of ``n`` rows in one file with one group of rows, shaped like the given one."""
    row = spark.read.parquet(f"{D}/{name}.parquet").limit(1).drop(key)
    df = spark.range(n).withColumnRenamed("id", key).crossJoin(row)
    df.coalesce(1).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def most(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rows_of_one_file_are_dealt(spark, tmp_path):
    path = one_file(spark, tmp_path, "customer", "c_custkey", 40_000)
    assert most(synth.view(spark, path, synth.HOSTILE)) < 6000
    path = one_file(spark, tmp_path, "part", "p_partkey", 40_000)
    assert most(Q.sops(spark, path)) < 6000
    path = one_file(spark, tmp_path, "documents", "doc_id", 16_000)
    assert most(N.documents(spark, path)) < 2600


def test_found_moves_no_texts(spark):
    moved = re.findall(r"Exchange hashpartitioning\((\w+)#", plan(S.found(Q.sops(spark, D))))
    assert moved == ["p_partkey"]


def test_a_layout_moves_no_combinations(spark):
    p = plan(Z.layout(K.questions(spark, D)))
    assert not re.search(r"Exchange hashpartitioning\([^)]*\bo#", p) and set(re.findall(r"Exchange hashpartitioning\((\w+)#", p)) == {"l_orderkey"}
    assert "Exchange hashpartitioning(doc_id" not in plan(Z.worst_strategy(Z.naive_scores(K.questions(spark, D), K.lengths()), 70.0))


def test_a_layout_and_its_scores_multiply_no_questions(spark):
    """Offsets and strategies are sums of one aggregation, not rows."""
    q = K.questions(spark, D)
    assert "Generate " not in plan(Z.layout(q))
    scores = plan(Z.naive_scores(q, K.lengths()))
    assert scores.index("Generate ") < scores.index("HashAggregate(keys=[doc_id#") and "strategy" not in "".join(re.findall(r"keys=\[.*?\]", scores))


def test_a_sweep_makes_no_texts(spark):
    f = A.facts(Q.sops(spark, D).where("doc_id < 30")).cache()
    sizes, whole = (A.attempted(f, (5,), (True,), texts=texts) for texts in (False, True))
    columns = [c for c in sizes.columns if c != "options"]
    want = whole.select(*columns, F.transform("options", lambda o: F.length(o)).alias("options"))
    assert dict(sizes.dtypes)["options"] == "array<int>" and "salt" not in sizes.columns
    assert sorted(map(str, sizes.select(*columns, "options").collect())) == sorted(map(str, want.collect()))


def test_stop_words_are_a_set(spark):
    """No list of them is read through for each word of a claim."""
    docs = Q.sops(spark, D)
    spans = S.lines(docs).select("doc_id", F.col("line").alias("text"), F.col("line_no").alias("s"), F.col("line_no").alias("e"))
    p = plan(G.verified(spans, docs))
    assert "INSET" in p and "array_contains([" not in p


def test_words_of_plain_and_other_texts(spark):
    texts = [None, "", "  ", "The A-1, 50% of_it!\t(Now)\n", "\x00a\x1fb\x7fc\x85d", "Ünder the Straße - 50 %", "ÀB c\u2003d", "A\u00a0b", "[x]\\^`{|}~;:'\"<>?/"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.T.normalized(F.col("t")).alias("n"), T.T.content_words(F.col("t")).alias("w"))
    for r in df.collect():
        want = re.sub(r"[^\w%]+", " ", (r.t or "").lower()).strip(" ")
        assert (r.n, r.w) == (want, [w for w in want.split(" ") if w and w not in T.T.STOPWORDS])


def test_bags_are_made_of_sentences_that_candidates_are_as_long_as(spark):
    docs = Q.sops(spark, D)
    wrong = docs.select("doc_id", F.lit(1).alias("cid"), F.lit("never open it").alias("_clip"), F.lit("never open it").alias("_norm"))
    p = plan(G.asserted(wrong, docs))
    assert "LeftSemi" in p


def test_lines_are_not_broadcast(spark):
    docs = Q.sops(spark, D)
    spans = S.lines(docs).select("doc_id", F.lit("x").alias("text"), F.col("line_no").alias("s"), F.col("line_no").alias("e"))
    wrong = S.lines(docs).select("doc_id", F.col("line_no").alias("cid"), F.col("line").alias("text"), F.lit("Wear gloves.").alias("correct"))
    found = N._scanned(docs).withColumn("severity", F.lit("low"))
    json = docs.select(F.col("doc_id").alias("job_id"), F.to_json(F.struct("text")).alias("json"))
    for df in (S.excerpts(docs, spans, 1), G.verified(spans, docs), G.distractors(wrong, docs), C.risks(docs, found), M.edits_by_category(json, json)):
        assert "BroadcastHashJoin" not in plan(df) and "SortMergeJoin" in plan(df)


def test_spans_beyond_a_document_make_no_rows(spark):
    """Each of these would ask for as many blocks as a list can't hold."""
    docs = spark.createDataFrame([(i, "a\nb\nc") for i in range(20)], "doc_id long, text string")
    spans = spark.createDataFrame([(i, 2, 2_000_000_000 + i) for i in range(20)] + [(3, 2, 3)], "doc_id long, s long, e long")
    assert [tuple(r) for r in S.excerpts(docs, spans, 1).collect()] == [(3, 2, 3, "a\nb\nc")]


def test_registers_sort_no_lines(spark):
    p = plan(T.registers(spark, D))
    assert "Sort [" not in p and "hashpartitioning(register" not in p


def test_registers_that_do_not_occur_make_no_rows(spark):
    lines = spark.createDataFrame([("Wear gloves.",), ("Check it.",), ("Operator: wears gloves",)], "line string")
    assert sorted(map(tuple, T.register_counts(lines).collect())) == [("imperative", 2, "Check it."), ("role", 1, "Operator: wears gloves")]


def test_only_lines_with_a_word_of_a_flip_are_altered(spark):
    p = plan(T.altered(spark, D))
    assert re.search(r"RLIKE\(line#\d+, \(\?i\)\\b\(\?:must\|", p)
    texts = [t for old, _ in T.T.FLIPS for t in (f"x {old.upper()} y", old.replace(" ", " \t"), f"a{old}b")] + ["", "Check it."]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(T.T.altered(F.col("t")).isNotNull().alias("a"), F.col("t"))
    assert {r["t"] for r in df.where("not a").collect()} == {"", "Check it.", *(f"a{old}b" for old, _ in T.T.FLIPS)}


def test_editable_items_move_and_make_no_more_than_they_need(spark):
    p = plan(J.editable_items(spark, D))
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#", p)) == {"p_partkey"} and "explode(array(concat(" not in p


def test_some_fields_are_those_of_the_whole_record(spark):
    texts = [None, "no", "[]", "null", "{}", '{"questions": null}', '{"questions": [{"options": ["a", "é"]}, {}, {"options": [1]}]}', '{"questions": [5]}', '{"learning_objectives": ["a"], "sections": [{"b": 1.0}], "title": 5, "x": 1}']
    df = spark.createDataFrame(list(enumerate(texts)), "job_id int, json string")
    for record, only in (("module", ["learning_objectives", "sections"]), ("assessment", ["questions"])):
        some, whole = B.rebuild(df, record, keep=["job_id"], only=only), B.rebuild(df, record, keep=["job_id"])
        if record == "assessment":
            some, whole = (d.withColumn("questions", F.transform("questions", lambda q: F.struct(q["options"].alias("options")))) for d in (some, whole))
        assert some.columns == ["job_id", *only] and sorted(map(str, some.collect())) == sorted(map(str, whole.select("job_id", *only).collect()))


def test_pairs_of_records_are_made_once(spark):
    old = spark.createDataFrame([(1, '{"a": [1, {"b": 1}, null], "c": {"d": 2}}'), (2, "{}"), (3, '{"a": 1}')], "job_id int, json string")
    new = spark.createDataFrame([(1, '{"a": [1, {"b": 2}], "c": {"d": 2}}'), (2, "{}"), (4, '{"a": 1}')], "job_id int, json string")
    df = M.differences(old, new)
    assert "Arrow" not in plan(df) and "Join" not in plan(df)
    assert sorted((r["job_id"], r["path"].replace("\x01", "/")) for r in df.collect()) == [(1, "/a/#1/b"), (1, "/a/#2"), (3, ""), (4, "")]
