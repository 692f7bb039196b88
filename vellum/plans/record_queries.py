"""Queries over event trails and job records, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators import audit as A
from vellum.operators import metrics as M
from vellum.plans import synth
from vellum.sources import rebuild as R
from vellum.sources.records import parsed_lines


def trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trails chained, then damaged where the marks say so."""
    raw = synth.view(spark, sf_dir, synth.TRAIL)
    content = F.when(F.col("event").isin(*A.CONTENT_EVENTS) & ~F.col("unhashed"), F.sha2(F.concat(F.lit("content-"), F.col("version").cast("string")), 256))
    made = A.chained(raw.select("job_id", "file_line", "seq", "ts", "event", F.struct(F.col("actor").alias("name")).alias("actor"), content.alias("content_hash"), F.lit('{"n":1}').alias("details")))
    marks = raw.select("job_id", "file_line", "tampered")
    return made.join(marks, ["job_id", "file_line"]).withColumn("actor", F.when(F.col("tampered"), F.struct(F.lit("mallory").alias("name"))).otherwise(F.col("actor"))).drop("tampered")


def chain_heads(spark, sf_dir):
    return trail(spark, sf_dir).groupBy("job_id").agg(F.max_by("hash", "file_line").alias("head_hash"), F.count(F.lit(1)).alias("entries"))


def continued_heads(spark, sf_dir):
    """Heads of the same trails made in three sittings, each going on from the heads stored before."""
    raw = synth.view(spark, sf_dir, synth.TRAIL)
    content = F.when(F.col("event").isin(*A.CONTENT_EVENTS) & ~F.col("unhashed"), F.sha2(F.concat(F.lit("content-"), F.col("version").cast("string")), 256))
    entries = raw.select("job_id", "file_line", "seq", "ts", "event", F.struct(F.col("actor").alias("name")).alias("actor"), content.alias("content_hash"), F.lit('{ "n" : 1 }').alias("details"))
    heads = None
    for some in ("file_line <= 7", "file_line between 8 and 30", "file_line > 30"):
        made = A.continued(entries.where(some), heads).groupBy("job_id").agg(F.max_by("hash", F.col("place")).alias("head_hash"), F.count(F.lit(1)).alias("entries"))
        if heads is not None:
            # jobs without new entries keep their heads
            made = heads.alias("a").join(made.alias("b"), "job_id", "full").select("job_id", F.coalesce("b.head_hash", "a.head_hash").alias("head_hash"), (F.coalesce("a.entries", F.lit(0)) + F.coalesce("b.entries", F.lit(0))).alias("entries"))
        heads = made
    return heads


def problems(spark, sf_dir):
    return A.problems(trail(spark, sf_dir))


def verdicts(spark, sf_dir):
    return A.verdicts(trail(spark, sf_dir))


def states(spark, sf_dir):
    return A.current_state(trail(spark, sf_dir))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.view(spark, sf_dir, synth.JOBS)


def overall(spark, sf_dir):
    return M.overall(jobs(spark, sf_dir))


def by_status(spark, sf_dir):
    return M.by_status(jobs(spark, sf_dir))


def by_source(spark, sf_dir):
    return M.by_source(jobs(spark, sf_dir))


def edit_categories(spark, sf_dir):
    return M.category_totals(jobs(spark, sf_dir), {"title": "edits_title", "questions": "edits_questions"})


def failed_audits(spark, sf_dir):
    return M.failed_audits(jobs(spark, sf_dir))


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Drafts and edited records as JSON, from parts."""
    p = synth.table(spark, sf_dir, "part")
    q = lambda text, b, c: F.struct(F.lit("q1").alias("id"), text.alias("text"), F.array(F.lit("a"), b, F.lit("c")).alias("options"), c.alias("correct_answer"))
    k = F.col("p_partkey")
    record = lambda title, objs, qs: F.to_json(F.struct(title.alias("title"), objs.alias("learning_objectives"), qs.alias("questions")), {"ignoreNullFields": "false"})
    old = p.select(k.alias("job_id"), record(F.col("p_name"), F.array("p_type", "p_brand"), F.array(q(F.col("p_name"), F.col("p_brand"), F.lit(0)))).alias("json"))
    title = F.when(k % 3 == 0, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name"))
    objectives = F.when(k % 4 == 0, F.array("p_type")).when(k % 4 == 1, F.array("p_type", F.lit("new"))).otherwise(F.array("p_type", "p_brand"))
    question = q(F.when(k % 5 == 0, F.lit("changed")).otherwise(F.col("p_name")), F.when(k % 7 == 0, F.lit("B")).otherwise(F.col("p_brand")), (k % 2).cast("int"))
    return old, p.select(k.alias("job_id"), record(title, objectives, F.array(question)).alias("json"))


def edit_counts(spark, sf_dir):
    """Edits by category between drafts and what reviewers sent back."""
    old, new = versions(spark, sf_dir)
    return M.edits_by_category(old, new)


def content_hashes(spark, sf_dir):
    """Digests of what a job holds, from JSON with keys and spaces as they come."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    module = F.concat(F.lit('{"title": "'), "p_name", F.lit('",  "id":'), F.col("p_partkey").cast("string"), F.lit(', "sections": [ {"z": 1, "a": "'), "p_brand", F.lit('é"} ], "none": null}'))
    return part.select(F.col("p_partkey").alias("job_id"), A.content_hash(module, F.lit('{"questions": [true, []], "passing_score": 70}')).alias("content_hash"))


def canonical(spark, sf_dir):
    """Texts with decimals, exponents, repeated keys and escapes in their one form."""
    return synth.view(spark, sf_dir, ODD_JSON).select("job_id", A.canonical(F.col("json")).alias("canonical"), A.content_hash(F.col("json"), F.lit('{"a": 1.0}')).alias("content_hash"))


def deep_edits(spark, sf_dir):
    """Differences of records nested up to 24 levels deep."""
    both = synth.view(spark, sf_dir, DEEP)
    return M.differences(both.select("job_id", F.col("old").alias("json")), both.select("job_id", F.col("new").alias("json")))


def deep_edit_counts(spark, sf_dir):
    both = synth.view(spark, sf_dir, DEEP)
    return M.edit_counts(both.select("job_id", F.col("old").alias("json")), both.select("job_id", F.col("new").alias("json")))


def modules(spark, sf_dir):
    """Training modules from saved records with missing, unknown and wrong keys, and the JSON that is saved again."""
    df = R.rebuild(synth.view(spark, sf_dir, MODULES), "module", keep=["job_id"])
    return df.select("job_id", "title", "estimated_duration", F.array_join("learning_objectives", "|").alias("objectives"), F.size("sections").alias("sections"), "summary", "rest", F.array_join(F.array_sort("faults"), ",").alias("faults"), "saved")


def assessments(spark, sf_dir):
    """Assessments from saved records; answer hashes are those of the options now, whatever is stored."""
    df = R.rebuild(synth.view(spark, sf_dir, ASSESSMENTS), "assessment", keep=["job_id"])
    q = F.get("questions", F.lit(0))
    return df.select("job_id", "passing_score", "requested_questions", "leakage_count", q["points"].alias("points"), q["answer_hash"].alias("answer_hash"), F.array_join(q["faults"], ",").alias("question_faults"), F.array_join("faults", ",").alias("faults"), F.length("saved").alias("saved_length"))


def documents(spark, sf_dir):
    """Records of all documents, lines and text, through JSON and back."""
    docs = synth.table(spark, sf_dir, "documents")
    json = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("raw_content"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"), F.col("lang").alias("version")))
    df = R.rebuild(docs.select(F.col("doc_id").alias("job_id"), json.alias("json")), "document", keep=["job_id"])
    return df.select("job_id", "version", F.size("lines").alias("lines"), F.sha2("saved", 256).alias("saved_sha256"), F.size("faults").alias("faults"))


def editable_items(spark, sf_dir):
    """What reviewers could edit of saved modules and assessments."""
    saved = lambda sql, name: synth.view(spark, sf_dir, sql).withColumnRenamed("json", name)
    # saved texts meet where they are dealt, before they are read
    both = saved(MODULES, "_module").join(saved(ASSESSMENTS, "_assessment").hint("merge"), "job_id")
    m = R.rebuild(both, "module", "_module", ["job_id", "_assessment"], only=["learning_objectives", "sections"])
    a = R.rebuild(m, "assessment", "_assessment", ["job_id", "learning_objectives", "sections"], only=["questions"])
    return a.select("job_id", M.editable_items(F.col("learning_objectives"), F.col("sections"), F.col("questions")).cast("long").alias("items"))


def review_times(spark, sf_dir):
    """Seconds between two moments of a review, none where one can't be read, never below 0."""
    return synth.view(spark, sf_dir, TIMES).select("job_id", M.seconds_between(F.col("began"), F.col("ended")).alias("seconds"))


def line_problems(spark, sf_dir):
    """What is wrong with damaged lines of trails."""
    lines = synth.view(spark, sf_dir, LINES)
    _, problems = parsed_lines(lines.select(F.col("job_id").alias("group"), F.lit("-").alias("path"), "file_line", "line", F.lit(False).alias("last")), F.col("group"))
    return problems


TIMES = """
select o_orderkey as job_id, case when o_orderkey % 7 = 0 then 'yesterday' else '2024-01-01T10:00:00+00:00' end as began,
  '2024-01-0' || (1 + o_orderkey % 3) || 'T' || lpad(cast(o_orderkey % 24 as string), 2, '0') || ':' || lpad(cast(o_orderkey % 60 as string), 2, '0') || ':00.250000+00:00' as ended
from orders
"""
#: Entries as lines, one of eleven damaged in each of so many ways.
LINES = """
select cast(user_id as string) as job_id, cast(event_id as int) as file_line, case event_id % 11 when 0 then '   ' when 1 then '{"seq": ' when 2 then '[' || event_id || ']' else
  '{"ts":' || case when event_id % 11 = 3 then '5' else '"2024-01-01T00:00:00+00:00"' end || ',"job_id":"j","event":"e","actor":' || case when event_id % 11 = 4 then '"x"' else '{"name":"x"}' end || case when event_id % 11 = 5 then '' else ',"details":{}' end
  || case when event_id % 11 = 6 then ',"zone":1,"extra":2' else '' end || ',"content_hash":' || case when event_id % 11 = 7 then '1' else 'null' end || ',"mac":null,"prev_hash":"","hash":"","seq":' || case event_id % 11 when 8 then 'true' when 9 then '1.0' else '1' end || '}' end as line
from events
"""
#: Saved modules: keys that are there or not, null, of another kind, or from a later version.
MODULES = """
select p_partkey as job_id, '{' || case when p_partkey % 3 <> 0 then '"title": "' || p_name || '", ' else '' end
  || case p_partkey % 4 when 0 then '"estimated_duration": ' || p_size || ', ' when 1 then '"estimated_duration": "' || p_size || '", ' when 2 then '"estimated_duration": null, ' else '' end
  || case p_partkey % 5 when 0 then '"learning_objectives": null, ' when 1 then '"learning_objectives": ["' || p_type || '", "' || p_brand || '"], ' when 2 then '"learning_objectives": ["' || p_type || '", 5], ' else '' end
  || case when p_partkey % 2 = 0 then '"sections": [{"id": "s1", "share": 1.0, "citations": [[1, ' || p_size || ']]}, {}], ' else '"sections": {}, ' end
  || case when p_partkey % 7 = 0 then '"future": {"n": ' || p_partkey || '}, ' else '' end || '"summary": "' || p_brand || ' é"}' as json
from part
"""
ASSESSMENTS = """
select p_partkey as job_id, '{"questions": [{"id": "q1", "options": ["' || p_name || '", "' || p_brand || '"], "correct_answer": ' || (p_partkey % 3) || ', "salt": "s' || p_partkey || '", "points": '
  || case p_partkey % 4 when 0 then '2.5' when 1 then 'true' else '3' end || ', "answer_hash": "stale"}' || case when p_partkey % 5 = 0 then ', {}' else '' end || ']'
  || case p_partkey % 6 when 0 then '' when 1 then ', "passing_score": null' when 2 then ', "passing_score": "80"' else ', "passing_score": 80' end || ', "leakage_count": ' || (p_partkey % 3) || ', "notes": ["n"]}' as json
from part
"""
#: Keys out of order and twice, numbers of all forms, escapes.
ODD_JSON = """select p_partkey as job_id, '{"price": 7, "b": {"y": 1.0, "x": 1e5, "x": [' || p_size || '.0, -0, 2.50]},  "a": "' || chr(92) || 'u00e9' || chr(92) || '/' || p_brand || '", "price": ' || p_size || '.50}' as json from part"""
#: Two versions of records of up to 24 levels: changed, added, removed and cut short.
DEEP = """
select p_partkey as job_id, '{"title":"' || p_name || '","deep":' || repeat('{"k":[0,', n) || '{"size":' || p_size || ',"type":"' || p_type || '"}' || repeat(']}', n) || '}' as old,
  '{"deep":' || repeat('{"k":[0,', m) || '{"size":' || (p_size + case when p_partkey % 3 = 0 then 1 else 0 end) || ',"type":"' || p_type || '"' || case p_partkey % 4 when 0 then ',"more":null' when 1 then ',"more":[1,{}]' else '' end || '}'
    || case when p_partkey % 6 = 1 and m > 0 then ',"new"' else '' end || repeat(']}', m) || ',"title":"' || case when p_partkey % 7 = 0 then p_brand else p_name end || '"}' as new
from (select *, cast(p_partkey % 12 as int) as n, cast(case when p_partkey % 5 = 0 then floor((p_partkey % 12) / 2) else p_partkey % 12 end as int) as m from part)
"""
QUERIES = {f"audit_{f.__name__}": f for f in (chain_heads, continued_heads, problems, verdicts, states, content_hashes, canonical)} | {f"records_{f.__name__}": f for f in (modules, assessments, documents, editable_items)} | {"metrics_review_times": review_times, "audit_line_problems": line_problems} | {f"metrics_{f.__name__}": f for f in (overall, by_status, by_source, edit_categories, failed_audits, edit_counts, deep_edits, deep_edit_counts)}

_content = ", ".join(f"'{e}'" for e in A.CONTENT_EVENTS)
_canon = """'{"actor":{"name":"' || {a} || '"},"content_hash":' || case when {c} is null then 'null' else '"' || {c} || '"' end || ',"details":{"n":1},"event":"' || {e} || '","job_id":"' || {j} || '","prev_hash":"' || {p} || '","seq":' || {s} || ',"ts":"' || {t} || '"}'"""


def _payload(alias: str, prev: str, actor: str = "actor") -> str:
    out = _canon
    for k, v in {"a": f"{alias}.{actor}", "c": f"{alias}.content_hash", "e": f"{alias}.event", "j": f"{alias}.job_id", "p": prev, "s": f"{alias}.seq", "t": f"{alias}.ts"}.items():
        out = out.replace("{" + k + "}", v)
    return out


_hash = lambda x: f"coalesce(regexp_matches({x}, '^[0-9a-f]{{64}}$'), false)"
TRAIL = f"""
recursive raw as materialized ({synth.TRAIL}),
ent as materialized (select *, case when event in ({_content}) and not unhashed then sha256('content-' || version) end as content_hash from raw),
made as (select job_id, file_line, '{A.GENESIS}' as prev_hash, sha256({_payload('e', f"'{A.GENESIS}'")}) as hash from ent e where file_line = 1
  union all select e.job_id, e.file_line, m.hash, sha256({_payload('e', 'm.hash')}) from made m join ent e on e.job_id = m.job_id and e.file_line = m.file_line + 1),
trail as (select e.* replace (case when tampered then 'mallory' else actor end as actor), prev_hash, hash from ent e join made using (job_id, file_line)),
t1 as (select *, case when regexp_matches(ts, '\\+00:00$') then ts end as good, lag(hash, 1, '{A.GENESIS}') over w as before, row_number() over w as pos,
  max(case when event = 'content.approved' then {{'l': file_line, 's': seq, 'c': content_hash}} end) over (partition by job_id) as ok from trail window w as (partition by job_id order by file_line)),
t2 as (select *, lag(good) over (partition by job_id order by file_line) as good_before, max(case when event = 'package.exported' and seq > ok.s then file_line end) over (partition by job_id) as last_export, {_hash('content_hash')} and {_hash('ok.c')} and content_hash = ok.c as same from t1),
problems as (
  select job_id, 1 as phase, file_line, 1 as sub, seq, 'contents do not match the hash' as problem from t2 t where hash <> sha256({_payload('t', 't.prev_hash')})
  union all select job_id, 1, file_line, 2, seq, 'does not chain to the entry before' from t2 where prev_hash <> before
  union all select job_id, 2, file_line, 1, least(seq, pos), 'seq is not contiguous' from t2 where seq <> pos
  union all select job_id, 2, file_line, 3, seq, 'unknown event' from t2 where event not in ({", ".join(f"'{e}'" for e in A.EVENTS)})
  union all select job_id, 2, file_line, 4, seq, 'ts is not a UTC timestamp' from t2 where good is null
  union all select job_id, 2, file_line, 5, seq, 'carries no content hash' from t2 where event in ({_content}) and content_hash is null
  union all select job_id, 3, file_line, 1, seq, 'timestamp goes backwards' from t2 where good < good_before
  union all select job_id, 4, file_line, 1, seq, 'trail does not start with job.created' from t2 where pos = 1 and event <> 'job.created'
  union all select job_id, 5, file_line, 1, seq, 'edited after approval' from t2 where event = 'content.edited' and seq > ok.s
  union all select job_id, 6, file_line, 1, seq, 'export is not what was approved' from t2 where file_line = last_export and not coalesce(same, false))
"""
_rate = "case when approved and editable_items > 0 then edits_count / editable_items end"
_jobs = f"with j as (select *, status = 'approved' as approved from ({synth.JOBS}))"
_both = lambda kind: f"json_type(a) = '{kind}' and json_type(b) = '{kind}'"
_deep = f"""with recursive p as (select job_id, '' as path, old::json as a, new::json as b from ({DEEP})
  union all select job_id, path || chr(1) || s.step, s.a, s.b from (select job_id, path, unnest(
    case when {_both("OBJECT")} then list_transform(list_distinct(json_keys(a) || json_keys(b)), lambda k: {{'step': k, 'a': coalesce(json_extract(a, k), 'null'::json), 'b': coalesce(json_extract(b, k), 'null'::json)}})
         when {_both("ARRAY")} then list_transform(range(greatest(json_array_length(a), json_array_length(b))::bigint), lambda i: {{'step': '#' || i, 'a': json_extract(a, i), 'b': json_extract(b, i)}}) end) as s from p)),
d as (select job_id, path, a::varchar as old, b::varchar as new from p where not coalesce({_both("OBJECT")} or {_both("ARRAY")}, false) and a::varchar is distinct from b::varchar)"""
_odd = """'{"a":"é/' || p_brand || '","b":{"x":[' || p_size || '.0,0,2.5],"y":1.0},"price":' || p_size || '.5}'"""
_modules = """select *, p_partkey % 3 <> 0 as titled, case when p_partkey % 5 = 1 then '["' || p_type || '","' || p_brand || '"]' else '[]' end as objs,
  case when p_partkey % 4 = 0 then p_size when p_partkey % 4 = 2 then null else 0 end as minutes, case when p_partkey % 2 = 0 then '[{"citations":[[1,' || p_size || ']],"id":"s1","share":1.0},{}]' else '[]' end as secs from part"""
_question = """'{"answer_hash":"' || hash || '","correct_answer":' || right_ || ',"explanation":"","id":"q1","options":["' || p_name || '","' || p_brand || '"],"points":' || points || ',"salt":"s' || p_partkey || '","source_ref":{},"text":"","topic":"","type":""}'"""
ORACLE_SQL = {
    "records_editable_items": "select p_partkey as job_id, (case when p_partkey % 5 = 1 then 2 else 0 end + case when p_partkey % 2 = 0 then 2 else 0 end + 3 + case when p_partkey % 5 = 0 then 1 else 0 end)::bigint as items from part",
    "metrics_review_times": "select o_orderkey as job_id, case when o_orderkey % 7 <> 0 then greatest(0, (o_orderkey % 3) * 86400 + (o_orderkey % 24) * 3600 + (o_orderkey % 60) * 60 + 0.25::double - 36000) end as seconds from orders",
    "audit_line_problems": """select * from (select user_id::varchar as job_id, event_id::int as file_line, case event_id % 11 when 0 then 'blank line' when 1 then 'not valid JSON' when 2 then 'entry is not an object' when 3 then 'ts is not a string' when 4 then 'actor is not an object'
        when 5 then 'missing fields: details' when 6 then 'unknown fields: extra, zone' when 7 then 'content_hash is not a string or null' when 8 then 'seq is not an integer' when 9 then 'seq is not an integer' end as problem from events) where problem is not null""",
    "records_modules": f"""select p_partkey as job_id, case when titled then p_name else '' end as title, minutes::bigint as estimated_duration, case when p_partkey % 5 = 1 then p_type || '|' || p_brand else '' end as objectives,
        case when p_partkey % 2 = 0 then 2 else 0 end as sections, p_brand || ' é' as summary, case when p_partkey % 7 = 0 then '{{"future":{{"n":' || p_partkey || '}}}}' end as rest,
        concat_ws(',', case when p_partkey % 4 = 1 then 'estimated_duration' end, case when p_partkey % 5 = 2 then 'learning_objectives' end, case when p_partkey % 2 = 1 then 'sections' end) as faults,
        '{{"estimated_duration":' || coalesce(minutes::varchar, 'null') || ',"learning_objectives":' || objs || ',"objectives":[],"prerequisites":[],"sections":' || secs || ',"summary":"' || p_brand || ' é","title":"' || case when titled then p_name else '' end || '"}}' as saved from ({_modules})""",
    "records_assessments": f"""with a as (select *, p_partkey % 3 as right_, case when p_partkey % 4 in (0, 1) then 1 else 3 end as points, case p_partkey % 6 when 1 then null when 0 then 70 when 2 then 70 else 80 end as mark,
          case p_partkey % 3 when 2 then '' else sha256('s' || p_partkey || '|' || trim(regexp_replace(lower(case p_partkey % 3 when 0 then p_name else p_brand end), '[^a-z0-9]+', ' ', 'g'))) end as hash from part)
        select p_partkey as job_id, mark::bigint as passing_score, case when p_partkey % 5 = 0 then 2 else 1 end::bigint as requested_questions, right_::bigint as leakage_count, points::bigint as points, hash as answer_hash, case when p_partkey % 4 in (0, 1) then 'points' else '' end as question_faults,
          case when p_partkey % 6 = 2 then 'passing_score' else '' end as faults,
          length('{{"description":"","leakage_count":' || right_ || ',"notes":["n"],"passing_score":' || coalesce(mark::varchar, 'null') || ',"questions":[' || {_question} || case when p_partkey % 5 = 0 then ',{{"answer_hash":"","correct_answer":null,"explanation":"","id":"","options":[],"points":1,"salt":"","source_ref":{{}},"text":"","topic":"","type":""}}' else '' end
            || '],"randomize_options":true,"randomize_questions":false,"requested_questions":' || case when p_partkey % 5 = 0 then 2 else 1 end || ',"time_limit":null,"title":""}}')::int as saved_length from a""",
    "records_documents": """select doc_id as job_id, lang as version, len(string_split(coalesce(text, ''), chr(10)))::int as lines, 0 as faults,
        sha256('{"definitions":{},"effective_date":"","injection_scan":{},"lines":' || to_json(string_split(coalesce(text, ''), chr(10)))::varchar || ',"procedures":[],"provenance":{},"purpose":"","raw_content":' || to_json(coalesce(text, ''))::varchar
          || ',"references":[],"responsibilities":[],"safety_warnings":[],"scope":"","title":"","version":' || coalesce(to_json(lang)::varchar, '""') || '}') as saved_sha256 from documents""",
    "audit_canonical": f"""select p_partkey as job_id, {_odd} as canonical, sha256('{{"assessment":{{"a":1.0}},"training_module":' || {_odd} || '}}') as content_hash from part""",
    "metrics_deep_edits": f"{_deep} select * from d",
    "metrics_deep_edit_counts": f"{_deep} select job_id, count(*) as edits from d group by job_id",
    "audit_content_hashes": """select p_partkey as job_id, sha256('{"assessment":{"passing_score":70,"questions":[true,[]]},"training_module":{"id":' || p_partkey || ',"none":null,"sections":[{"a":"' || p_brand || 'é","z":1}],"title":"' || p_name || '"}}') as content_hash from part""",
    "audit_chain_heads": f"with {TRAIL} select job_id, max_by(hash, file_line) as head_hash, count(*) as entries from trail group by job_id",
    "audit_continued_heads": f"with {TRAIL} select job_id, max_by(hash, file_line) as head_hash, count(*) as entries from trail group by job_id",
    "audit_problems": f"with {TRAIL} select * from problems",
    "audit_verdicts": f"""with {TRAIL}, b as (select job_id, count(*) as problems, min(seq) as first_bad_seq, arg_min(problem, phase * 100000000 + file_line * 10 + sub) as reason from problems group by job_id),
        m as (select job_id, count(*) as entries, max_by(hash, file_line) as head_hash, max(case when file_line = last_export then coalesce(same, false)::int end) = 1 as package_matches from t2 group by job_id)
        select job_id, problems is null as ok, entries, first_bad_seq, reason, coalesce(problems, 0) as problems, head_hash, package_matches from m left join b using (job_id)""",
    "audit_states": "with raw as (" + synth.TRAIL + ") select job_id, arg_max(case when event = 'content.approved' then 'approved' when event = 'content.edited' then 'in_review' else 'generated' end, file_line) filter (where event in ('content.approved', 'content.edited', 'job.created', 'content.generated')) as state, count(*) as events from raw group by job_id",
    "metrics_overall": f"""{_jobs} select count(*) as total_jobs, count(*) filter (where approved) as approved, (count(*) filter (where approved)) / count(*) as approval_rate, avg(edits_count) filter (where approved) as mean_edits, median(edits_count) filter (where approved) as median_edits,
        (sum(edits_count) filter (where approved and editable_items > 0)) / (sum(editable_items) filter (where approved and editable_items > 0)) as edit_rate, avg({_rate}) as mean_edit_rate, median(seconds_to_approve) filter (where approved) as median_seconds_to_approve, count(*) filter (where audit_verified = false) as failed_audits from j""",
    "metrics_by_status": f"{_jobs} select status, count(*) as jobs from j group by status",
    "metrics_by_source": f"{_jobs} select coalesce(nullif(source_filename, ''), '{M.UNKNOWN_SOURCE}') as source, count(*) as jobs, count(*) filter (where approved) as approved, (count(*) filter (where approved)) / count(*) as approval_rate, avg(edits_count) filter (where approved) as mean_edits, avg({_rate}) as mean_edit_rate from j group by 1",
    "metrics_edit_categories": f"{_jobs} select 'title' as category, sum(edits_title)::bigint as edits from j where approved union all select 'questions', sum(edits_questions)::bigint from j where approved",
    "metrics_failed_audits": f"{_jobs} select job_id from j where audit_verified = false",
    "metrics_edit_counts": "with k as (select p_partkey as job_id, p_partkey as k, p_brand from part) select * from (select job_id, 'title' as category, 1 as edits from k where k % 3 = 0 union all select job_id, 'objectives', 1 from k where k % 4 in (0, 1) union all select job_id, 'questions', 1 from k where k % 5 = 0 union all select job_id, 'question_options', 1 from k where k % 7 = 0 union all select job_id, 'question_answers', 1 from k where k % 2 = 1)",
}
