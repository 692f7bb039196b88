"""Queries over the structure of documents, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import structure as S
from vellum.plans import synth


def sops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.view(spark, sf_dir, synth.SOPS)


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.marked(S.lines(sops(spark, sf_dir)))


def headings(spark, sf_dir):
    return marked(spark, sf_dir).where("heading is not null").select("doc_id", "line_no", "heading", "strict", "first")


def section_texts(spark, sf_dir):
    return S.section_texts(marked(spark, sf_dir))


def title_version_date(spark, sf_dir):
    docs = sops(spark, sf_dir)
    t = S.titles(S.marked(S.lines(docs))).withColumnRenamed("line_no", "title_line")
    v = S.first_match(docs, S.VERSION, "version").withColumnsRenamed({"s": "version_s", "e": "version_e"})
    d = S.first_match(docs, S.DATE, "effective_date").withColumnsRenamed({"s": "date_s", "e": "date_e"})
    return t.join(v, "doc_id", "left").join(d, "doc_id", "left")


def responsibilities(spark, sf_dir):
    return S.responsibilities(marked(spark, sf_dir))


def definitions(spark, sf_dir):
    return S.definitions(marked(spark, sf_dir))


def warnings(spark, sf_dir):
    return S.warnings(marked(spark, sf_dir))


def steps(spark, sf_dir):
    return S.steps(marked(spark, sf_dir))


def substeps(spark, sf_dir):
    return S.substeps(S.procedure_lines(marked(spark, sf_dir)))


def step_order(spark, sf_dir):
    """Steps in natural order of their numbers, with the step that follows (for sequence questions)."""
    df = S.steps(marked(spark, sf_dir)).select("doc_id", "ord", "step_number", "title", S.step_key(F.col("step_number")).alias("k"))
    w = S.by_doc("k", "ord")
    return df.select("doc_id", F.row_number().over(w).alias("rank"), "step_number", F.lead("title").over(w).alias("next_title"))


def provenance_counts(spark, sf_dir):
    p = S.provenance(sops(spark, sf_dir))
    return p.groupBy("kind").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("doc_id").alias("docs"), F.sum(F.col("e") - F.col("s") + 1).cast("long").alias("lines"))


def warning_excerpts(spark, sf_dir):
    docs = sops(spark, sf_dir)
    return S.excerpts(docs, S.warnings(S.marked(S.lines(docs))).select("doc_id", "s", "e"), 1)


def purpose_fallback(spark, sf_dir):
    """Over texts without headings."""
    docs = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("About "), "p_name", F.lit("\nObjective: keep  the "), "p_brand", F.lit("\nin order\n\nEnd of text")).alias("text"))
    return S.fallback_text(docs, "purpose|objective")


def _loose(spark, sf_dir):
    """Texts whose sections are introduced by words, not by headings."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    text = F.concat(F.lit("About it\n"), F.when(F.col("p_partkey") % 2 == 0, F.lit("PURPOSE:\nTo have a heading\n\n")).otherwise(F.lit("The purpose: keep ")), F.col("p_brand"), F.lit("\n\nSome definitions \nA: one\nnothing\nB - two\nA: "), F.col("p_type"), F.lit("\nMore: end"))
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


def loose_sections(spark, sf_dir):
    docs = _loose(spark, sf_dir)
    return S.purpose_and_scope(docs, S.marked(S.lines(docs)))


def loose_definitions(spark, sf_dir):
    docs = _loose(spark, sf_dir)
    return S.loose_definitions(docs, S.marked(S.lines(docs)))


def citation_lines(spark, sf_dir):
    return S.lines(sops(spark, sf_dir)).select("doc_id", "line_no", T.numbered(F.col("line_no"), F.col("line")).alias("numbered"))


QUERIES = {f"structure_{f.__name__}": f for f in (headings, section_texts, title_version_date, responsibilities, definitions, warnings, steps, substeps, step_order, provenance_counts, warning_excerpts, purpose_fallback, loose_sections, loose_definitions, citation_lines)}

_strip = lambda x: f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_collapse = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_aliases = ", ".join(f"('{a}', '{s}')" for a, s in S.ALIASES.items())
MARKED = f"""
sops as ({synth.SOPS}),
lines as (select doc_id, unnest(generate_series(1, len(a))) as line_no, unnest(a) as line from (select doc_id, string_split(text, chr(10)) as a from sops)),
m1 as (select *, {_strip("line")} as body from lines),
m2 as (select *, case when regexp_matches(body, '{S.NUMBERING}') then {_strip(f"regexp_extract(body, '{S.NUMBERING}', 2)")} else body end as rest from m1),
m3 as (select *, case when ends_with(rest, ':') then {_strip("rest[:-2]")} else rest end as bare from m2),
m4 as (select m3.*, section from m3 left join (values {_aliases}) as al(alias, section) on lower(bare) = alias),
marked as (select doc_id, line_no, line, body, coalesce(section, case when regexp_matches(bare, '\\pL') and len(regexp_split_to_array(bare, '\\s+')) <= 6 and bare = upper(bare) then 'other' end) as heading, section is not null as strict from m4),
ranked as (select *, heading is not null and row_number() over (partition by doc_id, heading order by line_no) = 1 as first from marked),
held as (select *, last_value(case when heading is not null then {{'h': heading, 'f': first}} end ignore nulls) over (partition by doc_id order by line_no) as k from ranked),
inside as (select *, case when heading is null and k.f and k.h <> 'other' then k.h end as section from held)
"""
DEFS = f"""
d1 as (select *, case when contains(body, ':') then ':' when contains(body, ' - ') then ' - ' end as sep from inside where section = 'definitions'),
d2 as (select doc_id, line_no, {_strip("left(body, instr(body, sep) - 1)")} as term, {_strip("substr(body, instr(body, sep) + length(sep))")} as definition from d1 where sep is not null),
d3 as (select doc_id, term, max_by(definition, line_no) as definition, max(line_no) as line_no, min(line_no) as f from d2 where term <> '' and definition <> '' group by all),
definitions as (select doc_id, row_number() over (partition by doc_id order by f) as ord, term, definition, line_no from d3)
"""
WARN = f"""
w1 as (select *, regexp_matches(line, '{S.MARKER}') as start, body = '' or regexp_matches(line, '{S.STOP}') or heading is not null as brk from marked),
w2 as (select *, sum((brk or start)::int) over (partition by doc_id order by line_no) as run from w1),
w3 as (select *, max(case when start then run end) over (partition by doc_id order by line_no) as warned from w2),
w4 as (select doc_id, run, {_collapse(f"string_agg(case when start then {_strip(f'''regexp_extract(line, '{S.MARKER}', 2)''')} else body end, ' ' order by line_no)")} as text, min(line_no) as s, max(line_no) as e from w3 where run = warned group by all),
w5 as (select *, row_number() over (partition by doc_id, text order by s) as n from w4 where text <> ''),
warnings as (select doc_id, row_number() over (partition by doc_id order by s) - 1 as idx, text, s, e from w5 where n = 1)
"""
_num = "case " + " ".join(f"when regexp_matches(body, '{p}') then regexp_extract(body, '{p}', {{g}})" for p in S.STEPS) + " end"
_text = f"case when regexp_matches(line, '{S.SUBSTEP}') then regexp_extract(line, '{S.SUBSTEP}', 2) when regexp_matches(line, '{S.NUMERIC_SUBSTEP}') then regexp_extract(line, '{S.NUMERIC_SUBSTEP}', 2) else line end"
_sub = f"(regexp_matches(line, '{S.SUBSTEP}') or regexp_matches(line, '{S.NUMERIC_SUBSTEP}'))"
STEPS = f"""
p0 as (select *, max(case when heading = 'procedure' and first then 1 end) over (partition by doc_id) as has from inside),
p1 as (select *, {_num.format(g=1)} as num, {_strip(_num.format(g=2))} as head from p0 where has is null or section = 'procedure'),
p2 as (select *, length(num) - length(replace(num, '.', '')) as level from p1),
p3 as (select *, last_value(case when level < 2 then {{'l': line_no, 'n': num}} end ignore nulls) over w as base, last_value(case when level < 2 or strict then line_no end ignore nulls) over w as wall from p2 window w as (partition by doc_id order by line_no)),
p4 as (select *, num is not null and not coalesce(level = 2 and wall = base.l and base.n = regexp_extract(num, '^(.*)\\.[^.]*$', 1), false) as is_step from p3),
p5 as (select *, last_value(case when is_step then {{'l': line_no, 'on': true}} when strict then {{'l': line_no, 'on': false}} end ignore nulls) over (partition by doc_id order by line_no) as edge from p4),
proc as (select *, edge.l as step from p5 where edge."on"),
st as (select doc_id, step, max(case when is_step then num end) as step_number, max(case when is_step then head end) as title,
         coalesce({_collapse(f"string_agg(case when not is_step then {_text} end, ' ' order by line_no)")}, '') as body, count(*) filter (where not is_step and {_sub}) as n_substeps,
         max(case when is_step or body <> '' then line_no end) as e from proc group by all),
steps as (select doc_id, row_number() over (partition by doc_id order by step) as ord, step_number, title, body, case when title = '' then body else {_strip("title || chr(10) || body")} end as content, n_substeps, step as s, e from st)
"""


def _match(pattern: str, name: str) -> str:
    flagged = pattern.replace("(?i)", "(?i)(", 1) + ")"
    before = "(?is)^(.*?)" + pattern.replace("(?i)", "")
    return f"""(select doc_id, regexp_extract(text, '{pattern}', 1) as {name}, p as at, length(regexp_extract(text, '{flagged}', 1)) as n,
        length(p) - length(replace(p, chr(10), '')) + 1 as s, s + length(q) - length(replace(q, chr(10), '')) as e
        from (select *, regexp_extract(text, '{before}', 1) as p, regexp_extract(text, '{flagged}', 1) as q from sops where regexp_matches(text, '{pattern}')))"""


_w = f"with {MARKED}"
_title = "(select doc_id, min_by(body, line_no) as title, min(line_no) as title_line from marked where line_no <= 10 and body <> '' group by doc_id)"
_resp = f"(select doc_id, row_number() over (partition by doc_id order by line_no) - 1 as idx, text, line_no from (select doc_id, line_no, {_strip(f'''regexp_replace(body, '{S.BULLET}', '')''')} as text from inside where section = 'responsibilities' and body <> '') where text <> '')"
_texts = f"(select doc_id, section, {_collapse('''string_agg(body, ' ' order by line_no)''')} as text, min(line_no) as s, max(line_no) as e from inside where section is not null and body <> '' group by all)"
ORACLE_SQL = {
    "structure_headings": f"{_w} select doc_id, line_no, heading, strict, first from ranked where heading is not null",
    "structure_section_texts": f"{_w} select * from {_texts}",
    "structure_title_version_date": f"{_w} select t.*, version, v.s as version_s, v.e as version_e, effective_date, d.s as date_s, d.e as date_e from {_title} t left join {_match(S.VERSION, 'version')} v using (doc_id) left join {_match(S.DATE, 'effective_date')} d using (doc_id)",
    "structure_responsibilities": f"{_w} select * from {_resp}",
    "structure_definitions": f"{_w}, {DEFS} select * from definitions",
    "structure_warnings": f"{_w}, {WARN} select * from warnings",
    "structure_steps": f"{_w}, {STEPS} select * from steps",
    "structure_substeps": f"{_w}, {STEPS}, x as (select *, sum({_sub}::int) over (partition by doc_id, step order by line_no) as sub from proc where not is_step) select doc_id, step, sub, {_collapse(f'''string_agg({_text}, ' ' order by line_no)''')} as text from x where sub > 0 and body <> '' group by all",
    "structure_step_order": f"{_w}, {STEPS}, k as (select *, list_transform(string_split(step_number, '.'), lambda p: p::int) as key from steps) select doc_id, row_number() over w as rank, step_number, lead(title) over w as next_title from k window w as (partition by doc_id order by key, ord)",
    "structure_warning_excerpts": f"{_w}, {WARN} select doc_id, s, e, array_to_string(list_slice(string_split(text_, chr(10)), greatest(s - 1, 1), e + 1), chr(10)) as excerpt from warnings join (select doc_id, text as text_ from sops) using (doc_id)",
    "structure_provenance_counts": f"""{_w}, {DEFS}, {WARN}, {STEPS}, every as (select 'title' as kind, doc_id, title_line as s, title_line as e from {_title} union all select 'version', doc_id, s, e from {_match(S.VERSION, 'version')} union all select 'effective_date', doc_id, s, e from {_match(S.DATE, 'effective_date')}
        union all select section, doc_id, s, e from {_texts} where section in ('purpose', 'scope') union all select 'responsibilities', doc_id, line_no, line_no from {_resp} union all select 'definition', doc_id, line_no, line_no from definitions union all select 'safety', doc_id, s, e from warnings union all select 'step', doc_id, s, e from steps)
        select kind, count(*) as spans, count(distinct doc_id) as docs, sum(e - s + 1)::bigint as lines from every group by kind""",
    "structure_purpose_fallback": f"select p_partkey as doc_id, {_collapse('regexp_extract(text, $$(?is)(?:purpose|objective)[:\\s]+(.*?)(?:\\n\\n|\\n[A-Z]|\\z)$$, 1)')} as found, 2 as s from (select p_partkey, 'About ' || p_name || chr(10) || 'Objective: keep  the ' || p_brand || chr(10) || 'in order' || chr(10) || chr(10) || 'End of text' as text from part)",
    "structure_loose_sections": "select p_partkey as doc_id, 'purpose' as section, case when p_partkey % 2 = 0 then 'To have a heading ' || p_brand || ' Some definitions A: one nothing B - two' else 'keep ' || p_brand end as text, case when p_partkey % 2 = 0 then 3 else 2 end as s from part",
    "structure_loose_definitions": "select p_partkey as doc_id, 1 as ord, 'A' as term, 'one' as definition, l as line_no from (select *, case when p_partkey % 2 = 0 then 8 else 5 end as l from part) union all select p_partkey, 2, 'B', 'two', l + 2 from (select *, case when p_partkey % 2 = 0 then 8 else 5 end as l from part)",
    "structure_citation_lines": f"{_w} select doc_id, line_no, 'L' || lpad(line_no::varchar, 4, '0') || ': ' || line as numbered from lines",
}
