"""Queries over questions, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import quiz as Z
from vellum.operators import structure as S
from vellum.plans import structure_queries as Q
from vellum.plans import synth


def questions(spark, sf_dir):
    return synth.view(spark, sf_dir, synth.QUESTIONS)


def lengths():
    return F.slice(F.array("len_a", "len_b", "len_c", "len_d"), F.lit(1), F.col("n_options"))


def naive_scores(spark, sf_dir):
    return Z.naive_scores(questions(spark, sf_dir), lengths())


def worst_strategies(spark, sf_dir):
    """Every third document is medical, with the higher pass mark."""
    mark = F.when(F.col("doc_id") % 3 == 0, Z.PASS_MARKS[True]).otherwise(Z.PASS_MARKS[False])
    return Z.worst_strategy(Z.naive_scores(questions(spark, sf_dir), lengths()), mark)


def length_tells(spark, sf_dir):
    return Z.length_tells(questions(spark, sf_dir), lengths())


def truth_values(spark, sf_dir):
    return Z.truth_values(questions(spark, sf_dir)).where("type = 'true_false'").select("doc_id", "id", "truth")


def layout(spark, sf_dir):
    return Z.layout(questions(spark, sf_dir))


def question_types(spark, sf_dir):
    return Z.question_types(questions(spark, sf_dir))


def _hashed(spark, sf_dir):
    df = questions(spark, sf_dir)
    salt = T.salt(F.col("doc_id").cast("string"), F.col("id"))
    return df.withColumn("salt", salt).withColumn("answer_hash", T.answer_hash(salt, F.concat(F.lit("Option "), F.col("correct_answer").cast("string"))))


def grades(spark, sf_dir):
    df = _hashed(spark, sf_dir)
    said = df.where("pick % 4 <> 3").select("doc_id", "id", F.concat(F.lit("option, "), F.pmod("pick", "n_options").cast("string"), F.lit("!")).alias("option"))
    return Z.grade(df, said, 50)


def learner_view(spark, sf_dir):
    df = _hashed(spark, sf_dir).select("doc_id", "id", "type", "points", "correct_answer", F.lit("x").alias("explanation"), F.lit("y").alias("source_ref"), "salt", "answer_hash")
    return Z.learner_view(df)


def interactions(spark, sf_dir):
    df = questions(spark, sf_dir)
    options = F.when(F.col("type") == "true_false", F.array(F.lit(" False."), F.lit("True"))).otherwise(F.transform(F.sequence(F.lit(1), F.col("n_options")), lambda i: F.concat(F.lit("o"), i.cast("string"))))
    kind = F.when(F.col("l_partkey") % 3 == 0, "step")
    df = df.withColumns({"options": options, "kind": kind, "topic": F.concat(F.lit("Step "), "id", F.lit(" / ok")), "text": F.concat(F.lit("What  about\n"), F.repeat(F.concat(F.lit("part "), F.col("l_partkey").cast("string"), F.lit(" ")), F.lit(30)))})
    return Z.interactions(df)


def interaction_results(spark, sf_dir):
    """One question in five is left out; options may lie beyond the list."""
    said = questions(spark, sf_dir).where("pick % 5 <> 3").select("doc_id", "id", F.pmod("pick", F.col("n_options") + 1).alias("option"), (F.pmod("pick", F.col("n_options") + 1) == F.col("correct_answer")).alias("right"))
    return Z.interaction_results(interactions(spark, sf_dir), said)


def attempt_records(spark, sf_dir):
    """Interaction results with the time that each document's attempt took; one in seven has none."""
    results = interaction_results(spark, sf_dir).select("doc_id", "id", "version", "result")
    attempts = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_orderkey") * 37 % 100000 / 4.0).alias("seconds"))
    return Z.with_latency(results, attempts)


def suspended(spark, sf_dir):
    df = questions(spark, sf_dir).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat("id", F.lit(":"), F.col("l_partkey").cast("string")))).alias("r"))
    return df.select("doc_id", Z.suspend_data(F.col("r"), 40).alias("data"))


def spread_steps(spark, sf_dir):
    return Z.spread(S.steps(Q.marked(spark, sf_dir)).select("doc_id", "ord", "step_number"))


def interleaved(spark, sf_dir):
    df = questions(spark, sf_dir)
    own = lambda c: df.where(c).withColumn("ord", F.row_number().over(S.by_doc("ord"))).select("doc_id", "ord", "id")
    return Z.interleaved(own("type <> 'true_false'"), own("type = 'true_false'"), 1)


QUERIES = {f"quiz_{f.__name__}": f for f in (naive_scores, worst_strategies, length_tells, truth_values, layout, grades, learner_view, interactions, interaction_results, attempt_records, suspended, spread_steps, interleaved, question_types)}

_q = f"with q as ({synth.QUESTIONS})"
_st = "st(strategy, kind, aim, fallback) as (values " + ", ".join(map(str, Z.STRATEGIES)) + ")"
_pick = "case when kind = 'last' then n_options - 1 when aim < n_options then aim when fallback = 'first' then 0 else n_options - 1 end"
_lengths = "[len_a, len_b, len_c, len_d][:n_options]"
_by_text = f"case strategy when 'longest' then list_position({_lengths}, list_max({_lengths})) - 1 when 'shortest' then list_position({_lengths}, list_min({_lengths})) - 1 when 'always_true' then case when type = 'true_false' then 0 else -1 end else {_pick} end"
_all = _st.replace(" as (values ", " as (values ('longest', 'option', 0, 'last'), ('shortest', 'option', 0, 'last'), ('always_true', 'option', 0, 'last'), ")
_scores = f"scores as (select doc_id, strategy, 100.0::double * sum(case when {_by_text} = correct_answer then points else 0 end) / greatest(sum(points), 1) as score from q, st group by all)"
_okey = lambda x: f"trim(regexp_replace(lower({x}), '[^\\pL\\pN]+', ' ', 'g'))"
_salt = "left(sha256(doc_id || '|' || id || '|salt'), 32)"
_earned = ", ".join(
    f"sum(case when {'n_options - 1' if kind == 'last' else f'case when n_options > {aim} then {aim} else ' + ('0' if fallback == 'first' else 'n_options - 1') + ' end'} = position{'' if kind == 'last' else f' and {aim} < most'} then points else 0 end)" for _, kind, aim, fallback in Z.STRATEGIES
)
_bis = ", ".join(map(str, Z.bisection(64)))
ORACLE_SQL = {
    "quiz_question_types": f"{_q} select doc_id, type, count(*) as questions from q group by all",
    "quiz_naive_scores": f"{_q}, {_all}, {_scores} select * from scores",
    "quiz_worst_strategies": f"{_q}, {_all}, {_scores} select doc_id, strategy, score, score >= case when doc_id % 3 = 0 then 80 else 70 end as gameable from (select *, row_number() over (partition by doc_id order by score desc, strategy) as k from scores) where k = 1",
    "quiz_length_tells": f"{_q}, l as (select *, [len_a, len_b, len_c, len_d][:n_options] as a from q) select doc_id, sum(case when type = 'true_false' then points / 2 when a[correct_answer + 1] = list_max(a) then points else 0 end)::double as longest, sum(case when type = 'true_false' then points / 2 when a[correct_answer + 1] = list_min(a) then points else 0 end)::double as shortest, sum(points)::bigint as total from l group by doc_id",
    "quiz_truth_values": f"{_q.replace('with q', 'with recursive q')}, t as (select *, row_number() over (partition by doc_id order by ord) as k from q where type = 'true_false' and not fixed), f as (select doc_id, count(*) filter (where type = 'true_false' and fixed) as n from q group by doc_id), r as (select doc_id, id, k, false as truth, f.n as yes, 1 as no from t join f using (doc_id) where k = 1 union all select t.doc_id, t.id, t.k, not (r.no <= r.yes), r.yes + (case when r.no <= r.yes then 0 else 1 end), r.no + (case when r.no <= r.yes then 1 else 0 end) from r join t on t.doc_id = r.doc_id and t.k = r.k + 1) select doc_id, id, truth from r union all select doc_id, id, true from q where type = 'true_false' and fixed",
    "quiz_layout": f"""{_q}, {_st}, m as (select *, type <> 'true_false' as many, row_number() over (partition by doc_id, type <> 'true_false', n_options order by sha256(doc_id || '|' || id)) - 1 as rk from q),
        d as (select doc_id, max(case when many and n_options = 2 then 1 else 0 end) as p2, max(case when many and n_options = 3 then 1 else 0 end) as p3, max(case when many and n_options = 4 then 1 else 0 end) as p4, max(case when many then n_options end) as most, sum(points) as total from m group by doc_id),
        o as (select d.*, a, b, c from d, range(2) as x(a), range(3) as y(b), range(4) as z(c) where most is not null and (p2 = 1 or a = 0) and (p3 = 1 or b = 0) and (p4 = 1 or c = 0)),
        p as (select m.*, o.a, o.b, o.c, most, total, case when many then ((case n_options when 2 then o.a when 3 then o.b else o.c end) + rk) % n_options else correct_answer end as position from m join o using (doc_id)),
        w as (select doc_id, a, b, c, greatest({_earned}) / any_value(total) as worst from p group by all),
        k as (select *, min(worst) over (partition by doc_id) as least from w),
        s as (select *, row_number() over (partition by doc_id order by a, b, c) - 1 as place, count(*) over (partition by doc_id) as n from k where case when least <= {Z.CEILING} then worst <= {Z.CEILING} else worst = least end),
        ch as (select * from s where place = ('0x' || left(sha256(doc_id || '|answer-positions'), 8))::bigint % n)
        select p.doc_id, p.id, p.position, ch.worst from p join ch on ch.doc_id = p.doc_id and ch.a = p.a and ch.b = p.b and ch.c = p.c where many""",
    "quiz_grades": f"{_q}, g as (select *, pick % 4 <> 3 and pick % n_options = correct_answer as ok from q) select doc_id, score, missed, score >= 50 as passed from (select doc_id, floor(100.0::double * sum(case when ok then points else 0 end) / sum(points) + 0.5)::bigint as score, count(*) filter (where not ok) as missed from g group by doc_id)",
    "quiz_learner_view": f"{_q} select doc_id, id, type, points, {_salt} as salt, sha256({_salt} || '|' || {_okey('''('Option ' || correct_answer)''')}) as answer_hash from q",
    "quiz_interactions": f"""{_q} select doc_id, id, case when type = 'true_false' then 'true-false' else 'choice' end as type, points::varchar as weighting, left({Q._collapse('''('What  about' || chr(10) || repeat('part ' || l_partkey || ' ', 30))''')}, 250) as description, case when l_partkey % 3 = 0 then 'step' else 'step_' || id || '_ok' end as objective,
        case when type = 'true_false' then 'f,t' else array_to_string(['a', 'b', 'c', 'd'][:n_options], ',') end as responses12, case when type = 'true_false' then 'false,true' else array_to_string(['a', 'b', 'c', 'd'][:n_options], ',') end as responses2004 from q""",
    "quiz_interaction_results": f"""{_q}, a as (select *, case when pick % 5 <> 3 then pick % (n_options + 1) end as option from q)
        select doc_id, id, version, case when type = 'true_false' then 'true-false' else 'choice' end as type, points::varchar as weighting,
          case when option < n_options then case when type <> 'true_false' then chr(97 + option::int) when version = '1.2' then ['f', 't'][option + 1] else ['false', 'true'][option + 1] end end as response,
          case when option is null then 'neutral' when option = correct_answer then 'correct' when version = '1.2' then 'wrong' else 'incorrect' end as result from a, (values ('1.2'), ('2004')) as v(version)""",
    "quiz_suspended": f"{_q}, r as (select doc_id, x, row_number() over (partition by doc_id order by x) as k, 2 + sum(length(x) + 1) over (partition by doc_id order by x) as n from (select doc_id, id || ':' || l_partkey as x from q)) select doc_id, '[' || coalesce(string_agg(x, ',' order by k) filter (where n <= 40), '') || ']' as data from r group by doc_id",
    "quiz_spread_steps": f"with {Q.MARKED}, {Q.STEPS}, b(n, spread, place) as (values {_bis}), c as (select *, count(*) over (partition by doc_id) as n from steps) select doc_id, ord, step_number, spread from c join b on b.n = c.n and place = ord - 1",
    "quiz_interleaved": f"{_q}, a as (select doc_id, id, type = 'true_false' as tf, row_number() over (partition by doc_id, type = 'true_false' order by ord) as ord, count(*) over (partition by doc_id, type = 'true_false') as n from q) select doc_id, ord, id, row_number() over (partition by doc_id order by case when tf then (ord - 2 + n) % n else ord - 1 end, tf) as turn from a",
}
_cs = "case when doc_id % 7 = 0 then 0 else floor(doc_id * 37 % 100000 / 4.0 * 100)::bigint end"
ORACLE_SQL["quiz_attempt_records"] = f"""select doc_id, id, version, result, case version when '1.2' then printf('%04d:%02d:%02d.%02d', cs // 360000, cs % 360000 // 6000, cs % 6000 // 100, cs % 100) else printf('PT%dH%dM%.2fS', cs // 360000, cs % 360000 // 6000, (cs % 6000) / 100.0::double) end as latency
    from (select doc_id, id, version, result, {_cs} as cs from ({ORACLE_SQL["quiz_interaction_results"]}))"""
