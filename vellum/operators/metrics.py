"""Review metrics over job records, and edit counts between two versions of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.jsons import canonical, depth
from vellum.sources.shared import stored

# Fixed values.
CATEGORIES = ("title", "objectives", "sections", "questions", "question_options", "question_answers")
UNKNOWN_SOURCE = "(unknown source)"


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds from one ISO timestamp to another, never below 0, null if one can't be read."""
    a, b = F.try_to_timestamp(start), F.try_to_timestamp(end)
    apart = F.timestamp_diff("MICROSECOND", a, b) / 1e6
    return F.when(apart.isNotNull(), F.greatest(F.lit(0.0), apart))


def editable_items(objectives: Column, sections: Column, questions: Column) -> Column:
    """Objectives, sections, and one for each question and each of its options."""
    n = lambda x: F.coalesce(F.array_size(x), F.lit(0))
    return n(objectives) + n(sections) + F.aggregate(F.coalesce(questions, F.array().cast("array<struct<options:array<string>>>")), F.lit(0), lambda a, q: a + 1 + n(q["options"]))


def _approved() -> Column:
    return F.col("status") == "approved"


def overall(jobs: DataFrame) -> DataFrame:
    """One row. Rates without a denominator are null, never 0; counts and edits are over approved jobs."""
    own, rated = _approved(), _approved() & (F.col("editable_items") > 0)
    edits = F.when(own, F.col("edits_count"))
    return jobs.agg(
        F.count(F.lit(1)).alias("total_jobs"), F.count_if(own).alias("approved"), F.try_divide(F.count_if(own), F.count(F.lit(1))).alias("approval_rate"), F.avg(edits).alias("mean_edits"), F.median(edits).alias("median_edits"),
        F.try_divide(F.sum(F.when(rated, F.col("edits_count"))), F.sum(F.when(rated, F.col("editable_items")))).alias("edit_rate"), F.avg(F.when(rated, F.col("edits_count") / F.col("editable_items"))).alias("mean_edit_rate"),
        F.median(F.when(own, F.col("seconds_to_approve"))).alias("median_seconds_to_approve"), F.count_if(F.col("audit_verified") == F.lit(False)).alias("failed_audits"),
    )


def by_status(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("jobs"))


def by_source(jobs: DataFrame) -> DataFrame:
    own = _approved()
    return jobs.groupBy(F.coalesce(F.nullif("source_filename", F.lit("")), F.lit(UNKNOWN_SOURCE)).alias("source")).agg(
        F.count(F.lit(1)).alias("jobs"), F.count_if(own).alias("approved"), F.try_divide(F.count_if(own), F.count(F.lit(1))).alias("approval_rate"), F.avg(F.when(own, F.col("edits_count"))).alias("mean_edits"),
        F.avg(F.when(own & (F.col("editable_items") > 0), F.col("edits_count") / F.col("editable_items"))).alias("mean_edit_rate"),
    )


def category_totals(jobs: DataFrame, categories: dict[str, str]) -> DataFrame:
    """(category, edits) over approved jobs; ``categories``: column by category."""
    sums = jobs.where(_approved()).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(k) for k, c in categories.items()])
    return sums.unpivot([], list(categories), "category", "edits")


def failed_audits(jobs: DataFrame) -> DataFrame:
    """Jobs whose trail exists and failed; a job without a trail (null) is not one."""
    return jobs.where(F.col("audit_verified") == F.lit(False)).select("job_id")


def differences(old: DataFrame, new: DataFrame, json_col: str = "json", key: str = "job_id") -> DataFrame:
    """(key, path, old, new): where two versions of a record differ, the least parts that do, as canonical JSON.

    Objects are compared key by key, lists place by place, to any depth; anything else is
    one difference if it isn't equal, so that a part that one side lacks is one, however
    much it holds. A missing key equals null, a missing list element (null here) equals
    nothing. Numbers are equal by value, as are true and 1. A record without the other
    version, or that is no JSON, is compared with null. Paths are separated by U+0001 and list places are
    written as #n.

    Every level is one step without a shuffle; how many there are is measured first, on
    pairs that are made once. Parts that are the same text on both sides go no further.
    """
    side = lambda df, name: df.select(key, canonical(F.col(json_col)).alias(name))
    pairs = side(old, "_a").join(side(new, "_b"), key, "full").where("not _a <=> _b")
    least = F.least(depth(F.coalesce("_a", F.lit("null"))), depth(F.coalesce("_b", F.lit("null"))))
    pairs = stored(pairs.withColumn("_d", least), "pairs")
    df = pairs.select(key, F.lit("").alias("path"), F.struct(F.coalesce(F.try_parse_json("_a"), F.parse_json(F.lit("null"))).alias("a"), F.coalesce(F.try_parse_json("_b"), F.parse_json(F.lit("null"))).alias("b")).alias("x"))
    for _ in range(pairs.agg(F.max("_d")).first()[0] or 0):
        df = df.select(key, "path", F.explode(F.expr(CHILDREN)).alias("c")).where(~F.expr(SAME)).select(key, F.concat("path", "c.step").alias("path"), F.col("c.x").alias("x"))
    return df.where(~F.expr(EQUAL)).select(key, "path", F.to_json(F.col("x.a")).alias("old"), F.to_json(F.col("x.b")).alias("new"))


#: Both versions' children by key or place; anything but two objects or two lists stays as it is.
CHILDREN = """
case when schema_of_variant(x.a) like 'OBJECT%' and schema_of_variant(x.b) like 'OBJECT%' then
  transform(array(struct(try_variant_get(x.a, '$', 'map<string,variant>') as a, try_variant_get(x.b, '$', 'map<string,variant>') as b)),
    m -> transform(array_union(map_keys(m.a), map_keys(m.b)), k -> struct('\\u0001' || k as step, struct(coalesce(try_element_at(m.a, k), parse_json('null')) as a, coalesce(try_element_at(m.b, k), parse_json('null')) as b) as x)))[0]
when schema_of_variant(x.a) like 'ARRAY%' and schema_of_variant(x.b) like 'ARRAY%' then
  transform(array(struct(try_variant_get(x.a, '$', 'array<variant>') as a, try_variant_get(x.b, '$', 'array<variant>') as b)),
    m -> transform(filter(sequence(0, greatest(size(m.a), size(m.b))), i -> i < greatest(size(m.a), size(m.b))), i -> struct('\\u0001#' || i as step, struct(get(m.a, i) as a, get(m.b, i) as b) as x)))[0]
else array(struct('' as step, x)) end"""
#: Whether a child is the same text on both sides.
SAME = "coalesce(c.x.a is not null and c.x.b is not null and to_json(c.x.a) = to_json(c.x.b), false)"
_whole = "(schema_of_variant({0}) = 'BIGINT' or schema_of_variant({0}) like 'DECIMAL(%,0)')"
_number = "(schema_of_variant({0}) in ('BIGINT', 'DOUBLE', 'BOOLEAN') or schema_of_variant({0}) like 'DECIMAL%')"
_value = "coalesce(try_variant_get({0}, '$', 'double'), cast(try_variant_get({0}, '$', 'boolean') as double))"
EQUAL = f"""
coalesce(x.a is not null and x.b is not null and (to_json(x.a) = to_json(x.b) or
  {_number.format("x.a")} and {_number.format("x.b")} and not ({_whole.format("x.a")} and {_whole.format("x.b")}) and {_value.format("x.a")} = {_value.format("x.b")}), false)"""


def category(path: Column) -> Column:
    """The category of a difference by its path; answers are counted by text, see answer_changes()."""
    sep = "\x01"
    return (
        F.when(path.startswith(f"{sep}title"), "title").when(path.startswith(f"{sep}learning_objectives"), "objectives").when(path.startswith(f"{sep}sections"), "sections")
        .when(path.rlike(f"^{sep}questions{sep}#\\d+{sep}options"), "question_options").when(path.rlike(f"^{sep}questions{sep}#\\d+{sep}correct_answer$"), F.lit(None)).when(path.startswith(f"{sep}questions"), "questions")
    )


def edits_by_category(old: DataFrame, new: DataFrame, json_col: str = "json", key: str = "job_id") -> DataFrame:
    """(key, category, edits) between two versions of records with title, learning_objectives, sections and questions; answers are counted by the correct option's text."""
    parts = differences(old, new, json_col, key).select(key, category(F.col("path")).alias("category")).where("category is not null")
    texts = lambda df, name: df.select(key, F.expr(CORRECT.format(json_col)).alias(name))
    both = texts(old, "_a").join(texts(new, "_b").hint("merge"), key)
    moved = both.select(key, F.expr("size(filter(arrays_zip(slice(_a, 1, least(size(_a), size(_b))), slice(_b, 1, least(size(_a), size(_b)))), z -> not z.`0` <=> z.`1`))").alias("n")).where("n > 0")
    counts = parts.groupBy(key, "category").agg(F.count(F.lit(1)).alias("edits"))
    return counts.unionByName(moved.select(key, F.lit("question_answers").alias("category"), F.col("n").cast("long").alias("edits")))


#: The text of each question's correct option, null where the index is none of its options.
CORRECT = """
transform(coalesce(try_variant_get(try_parse_json({0}), '$.questions', 'array<variant>'), array()), q ->
  case when schema_of_variant(try_variant_get(q, '$.correct_answer', 'variant')) = 'BIGINT' and try_variant_get(q, '$.correct_answer', 'long') >= 0
       then to_json(get(try_variant_get(q, '$.options', 'array<variant>'), cast(try_variant_get(q, '$.correct_answer', 'long') as int))) end)"""


def edit_counts(old: DataFrame, new: DataFrame, json_col: str = "json", key: str = "job_id") -> DataFrame:
    """(key, edits): all least differences of records that have any."""
    return differences(old, new, json_col, key).groupBy(key).agg(F.count(F.lit(1)).alias("edits"))


def answer_changes(questions: DataFrame) -> DataFrame:
    """Counts questions whose correct option's *text* changed. Needs job_id, options, correct, new_options, new_correct."""
    old, new = F.try_element_at("options", F.col("correct") + 1), F.try_element_at("new_options", F.col("new_correct") + 1)
    return questions.groupBy("job_id").agg(F.count_if(~old.eqNullSafe(new)).alias("edits"))
