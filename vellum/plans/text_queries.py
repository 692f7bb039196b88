"""Queries of scalar functions and of generated content, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import generation as G
from vellum.operators import structure as S
from vellum.plans import structure_queries as Q
from vellum.plans import synth
from vellum.sources.shared import stored


def _docs(spark, sf_dir):
    return synth.table(spark, sf_dir, "documents").select("doc_id", "text")


def _lines(spark, sf_dir):
    return S.lines(Q.sops(spark, sf_dir))


def sentences(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


def clipped(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.clip(F.col("text")).alias("option"), T.truncate(F.col("text"), 100).alias("short"))


def altered(spark, sf_dir):
    lines = _lines(spark, sf_dir).where(T.alterable(F.col("line")))
    return lines.select("doc_id", "line_no", T.altered(F.col("line")).alias("altered")).where("altered is not null")


def registers(spark, sf_dir):
    return register_counts(_lines(spark, sf_dir))


def register_counts(lines):
    """(register, lines, first_line) of the registers that occur. Grouped by register, every task would sort all its lines, as a least text can't be kept in a hash table; one row of all registers takes no sort and no memory."""
    own = lambda r: F.col("register") == r
    row = lines.select("line", T.register(F.col("line")).alias("register")).agg(*[c for r in T.REGISTERS for c in (F.count_if(own(r)).alias(f"n_{r}"), F.min(F.when(own(r), F.col("line"))).alias(f"first_{r}"))])
    each = F.array(*[F.struct(F.lit(r).alias("register"), F.col(f"n_{r}").alias("lines"), F.col(f"first_{r}").alias("first_line")) for r in T.REGISTERS])
    return row.select(F.inline(each)).where("lines > 0")


def option_keys(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.option_key(F.col("text")), 256).alias("key_sha256"))


def content_words(spark, sf_dir):
    t = F.col("text")
    words = T.content_words(t)
    return _docs(spark, sf_dir).select("doc_id", F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("words_sha256"), F.array_join(T.polarity(t), " ").alias("polarity"))


def numbers(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.select("doc_id", "line_no", F.array_join(F.array_sort(T.numbers(F.col("line"))), " ").alias("numbers"), F.array_join(T.named_terms(F.col("line")), " ").alias("terms"))


def keys(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = T.document_key(F.col("p_name"), F.col("p_brand"))
    salt = T.salt(key, F.lit("q1"))
    return p.select("p_partkey", key.alias("document_key"), salt.alias("salt"), T.answer_hash(salt, F.col("p_type")).alias("answer_hash"), T.question_digest(key, F.lit("q1")).alias("digest"))


def formats(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    html = T.escaped(F.concat(F.lit("<b>"), "p_name", F.lit("</b> & 'x' \"y\"")))
    return p.select("p_partkey", html.alias("html"), T.slug(F.concat("p_name", F.lit(" -- "), "p_brand")).alias("slug"), T.listed(F.slice(F.array("p_name", "p_brand", "p_type"), F.lit(1), F.pmod("p_partkey", F.lit(3)).cast("int") + 1)).alias("listed"), T.scaled_points(F.col("p_size"), F.pmod("p_partkey", F.lit(5))).alias("points"))


def durations_of_attempts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 37 % 100000 / 4.0 - 10).alias("s"))
    return o.select("o_orderkey", T.timespan(F.col("s")).alias("timespan"), T.duration(F.col("s")).alias("duration"))


def unicode_keys(spark, sf_dir):
    """Option keys with compatibility forms unified, over documents written in them."""
    df = _docs(spark, sf_dir).select("doc_id", F.translate("text", "aeio", "ａｅｉｏ").alias("text"))
    return df.select("doc_id", F.sha2(T.option_key(F.col("text"), unicode=True), 256).alias("key_sha256"))


def objectives(spark, sf_dir):
    return G.objectives(S.found(Q.sops(spark, sf_dir)))


def sections(spark, sf_dir):
    return G.sections(S.found(Q.sops(spark, sf_dir)))


def bodies(spark, sf_dir):
    return G.bodies(S.found(Q.sops(spark, sf_dir)))


def durations(spark, sf_dir):
    docs = Q.sops(spark, sf_dir)
    return G.durations(docs, S.steps(S.marked(S.lines(docs))))


def definition_html(spark, sf_dir):
    return G.definition_html(S.definitions(Q.marked(spark, sf_dir)))


def citation_coverage(spark, sf_dir):
    """Coverage of section citations and of references that questions make, some of them to nothing."""
    docs = Q.sops(spark, sf_dir)
    prov = stored(S.provenance(docs), "provenance")  # what is found, once, for both buckets
    k = F.col("doc_id")
    ref = lambda kind, cond, **c: F.when(cond, F.struct(F.lit(kind).alias("kind"), c.get("term", F.lit(None)).cast("string").alias("term"), c.get("n", F.lit(None)).cast("string").alias("step_number"), c.get("w", F.lit(None)).cast("int").alias("warning_index"), c.get("s", F.lit(None)).cast("int").alias("s"), c.get("e", F.lit(None)).cast("int").alias("e")))
    every = F.filter(F.array(ref("purpose", k % 2 == 0), ref("scope", k % 2 == 1), ref("definition", k % 3 == 0, term=F.lit("E-Stop")), ref("step", k % 4 == 0, n=F.lit("2")), ref("step", k % 4 == 1, s=F.lit(3), e=F.lit(4)), ref("step", k % 4 == 2, s=F.lit(9), e=F.lit(999), n=F.lit("4.2")), ref("sequence", k % 5 == 0, n=F.lit("3")), ref("safety", k % 5 == 1, w=F.lit(1)), ref("md_required", k % 6 == 0)), lambda x: x.isNotNull())
    refs = docs.select("doc_id", F.explode(every).alias("r")).select("doc_id", "r.*")
    questions = G.resolved(refs, prov, docs).select("doc_id", F.lit("questions").alias("bucket"), "status")
    cited = G.citations(prov).select("doc_id", F.lit("sections").alias("bucket"), F.lit("cited").alias("status"))
    return G.coverage(questions.union(cited))


def reports(spark, sf_dir):
    from vellum.plans.scan_queries import C, R, _scanned

    docs = Q.sops(spark, sf_dir)
    found = _scanned(docs).withColumn("severity", F.when(F.col("kind").isin(*R.HIGH_KINDS), "high").otherwise("low"))
    risks = C.risks(docs, found).where("doc_id % 10 <> 0")
    return G.reports(docs, risks)


def full_reports(spark, sf_dir):
    """Reports with the approvals that some documents have, and the coverage of their citations."""
    docs = Q.sops(spark, sf_dir)
    none = spark.createDataFrame([], "doc_id long, risk string")
    approvals = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).alias("approved_by"), F.lit("QA").alias("role"), (F.col("p_partkey") % 4).cast("int").alias("edits_count"))
    df = G.reports(docs, none, approvals=approvals, shares=citation_coverage(spark, sf_dir))
    return df.select("doc_id", "source_md5", "risk", "coverage_pct", *[F.col(f"approval.{c}").alias(c) for c in G.APPROVAL])


QUERIES = {f"text_{f.__name__}": f for f in (sentences, clipped, altered, registers, option_keys, content_words, numbers, keys, formats, durations_of_attempts, unicode_keys)} | {f"content_{f.__name__}": f for f in (objectives, sections, bodies, durations, definition_html, citation_coverage, reports, full_reports)}

_c = Q._collapse
_l = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_norm = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\pL\\pN_\\s%]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_tok = lambda x: f"list_filter(string_split({_norm(x)}, ' '), lambda w: w <> '')"
_cut = f"case when space > {177 * 0.6} then left(head, space) else left(t, 177) end"
_flip = "coalesce(" + ", ".join(f"case when regexp_matches(t, '(?i)\\b{a}\\b') then (select p || case when regexp_matches(substr(t, length(p) + 1, 1), '^[A-Z]') then '{b[:1].upper() + b[1:]}' else '{b}' end || substr(t, length(p) + 1 + {len(a)}) from (select regexp_extract(t, '(?is)^(.*?)\\b{a}\\b', 1) as p)) end" for a, b in T.FLIPS) + ")"
_key = "sha256(trim(p_name) || '|' || trim(p_brand))"
_okey = lambda x: f"trim(regexp_replace(lower({x}), '[^\\pL\\pN]+', ' ', 'g'))"
_w = f"with {Q.MARKED}"
_e = lambda x: f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_opt = lambda a, x, b: f"coalesce(chr(10) || '{a}' || {x} || '{b}', '')"
ORACLE_SQL = {
    "content_bodies": f"""{_w}, {Q.DEFS}, {Q.WARN}, {Q.STEPS}, tx as (select * from {Q._texts}),
        y as (select *, sum({Q._sub}::int) over (partition by doc_id, step order by line_no) as sub from proc where not is_step),
        z as (select doc_id, step, sub, {_c(f"string_agg({Q._text}, ' ' order by line_no)")} as text from y where sub > 0 and body <> '' group by all),
        sb as (select doc_id, step, string_agg('<li>' || {_e('text')} || '</li>', chr(10) order by sub) as subs from z group by all),
        li as (select s.doc_id, count(*) as n, string_agg('<li><strong>Step ' || step_number || case when title <> '' then ': ' || {_e('title')} else '' end || '</strong>' || {_opt('<p>', _e("nullif(coalesce(nullif(s.body, ''), title), '')"), '</p>')}
            || coalesce(chr(10) || '<ol type=''a''>' || chr(10) || subs || chr(10) || '</ol>', '') || chr(10) || '</li>', chr(10) order by ord) as h from steps s left join sb on sb.doc_id = s.doc_id and sb.step = s.s group by s.doc_id),
        wn as (select doc_id, count(*) as n, string_agg('<li><strong>WARNING:</strong> ' || {_e('text')} || '</li>', chr(10) order by idx) as h from warnings group by doc_id),
        df as (select doc_id, string_agg('<dt><strong>' || {_e('term')} || '</strong></dt>' || chr(10) || '<dd>' || {_e('definition')} || '</dd>', chr(10) order by ord) as h from definitions group by doc_id),
        rs as (select doc_id, string_agg('<li>' || {_e('text')} || '</li>', chr(10) order by idx) as h from {Q._resp} group by doc_id),
        a as (select d.doc_id, title, version, effective_date, p.text as aim, q.text as scope, rs.h as rs, wn.h as wn, wn.n as n_w, df.h as df, li.h as li, li.n as n_s from sops d left join {Q._title} t using (doc_id) left join {Q._match(S.VERSION, 'version')} v using (doc_id) left join {Q._match(S.DATE, 'effective_date')} e using (doc_id)
          left join (select * from tx where section = 'purpose') p using (doc_id) left join (select * from tx where section = 'scope') q using (doc_id) left join rs using (doc_id) left join wn using (doc_id) left join df using (doc_id) left join li using (doc_id))
        select doc_id, 'intro' as id, '<h2>Welcome to the Training Module: ' || {_e('title')} || '</h2>' || {_opt('<p><strong>Version:</strong> ', _e('version'), '</p>')} || {_opt('<p><strong>Effective Date:</strong> ', _e('effective_date'), '</p>')} || {_opt('<h3>Purpose</h3><p>', _e('aim'), '</p>')} || {_opt('<h3>Scope</h3><p>', _e('scope'), '</p>')}
          || coalesce(chr(10) || '<h3>Responsibilities</h3><ul>' || chr(10) || rs || chr(10) || '</ul>', '') as html from a
        union all select doc_id, 'safety', '<h2>Safety and Precautions</h2>' || chr(10) || '<div class=''safety-alert''>' || chr(10) || '<p><strong>⚠️ IMPORTANT:</strong> Please read and understand all safety warnings before proceeding.</p>' || chr(10) || '</div>' || chr(10) || '<ul class=''safety-warnings''>' || chr(10) || wn || chr(10) || '</ul>' from a where wn is not null
        union all select doc_id, 'definitions', '<h2>Key Terms and Definitions</h2>' || chr(10) || '<dl class=''definitions''>' || chr(10) || df || chr(10) || '</dl>' from a where df is not null
        union all select doc_id, 'procedures', '<h2>Procedure Steps</h2>' || chr(10) || '<p>Follow these steps carefully to complete the procedure:</p>' || chr(10) || '<ol class=''procedure-steps''>' || coalesce(chr(10) || li, '') || chr(10) || '</ol>' from a
        union all select doc_id, 'summary', '<h2>Summary and Key Points</h2>' || chr(10) || '<p>Let''s review the key points from this training:</p>' || chr(10) || '<ul class=''key-points''>'
          || {_opt('<li>The purpose of this procedure is: ', _e("case when length(aim) <= 150 then aim else regexp_replace(left(aim, 150), ' [^ ]*$', '') end"), '</li>')} || {_opt('<li>This procedure consists of ', 'n_s', ' main steps</li>')} || {_opt('<li>There are ', 'n_w', ' critical safety warnings to remember</li>')} || chr(10) || '</ul>' || chr(10) || '<p><strong>Next:</strong> Complete the verification assessment to test your knowledge.</p>' from a""",
    "text_sentences": f"select doc_id, (row_number() over (partition by doc_id order by k) - 1)::int as pos, s as sentence from (select doc_id, unnest(generate_series(1, len(a))) as k, trim(unnest(a)) as s from (select doc_id, string_split(regexp_replace({_c('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) as a from documents)) where length(s) >= 20",
    "text_clipped": f"select doc_id, case when length(t) <= 180 then t else regexp_replace({_cut}, '[ ,;:.\\-]+$', '') || '...' end as option, case when length(u) <= 100 then u when length(regexp_replace(left(u, 100), ' [^ ]*$', '')) > 0 then regexp_replace(left(u, 100), ' [^ ]*$', '') else left(u, 100) end as short from (select *, left(t, 178) as head, length(left(t, 178)) - instr(reverse(left(t, 178)), ' ') as space from (select doc_id, {_c('text')} as t, {Q._strip('text')} as u from documents))",
    "text_altered": f"{_w} select * from (select doc_id, line_no, {_flip} as altered from (select doc_id, line_no, {_c('line')} as t from lines)) where altered is not null",
    "text_registers": f"""{_w}, r1 as (select line, {_c('line')} as t, regexp_extract_all({_c('line')}, '[A-Za-z][A-Za-z''\\-]*') as own from lines),
        r2 as (select *, case when list_contains({_l(T.CLAUSE_OPENERS)}, lower(own[1])) and contains(t, ',') then regexp_extract_all(substr(t, instr(t, ',') + 1), '[A-Za-z][A-Za-z''\\-]*') else own end as tk from r1),
        r3 as (select *, least(coalesce(nullif(list_position(list_transform(tk, lambda x: not ends_with(lower(x), 'ly')), true), 0) - 1, len(tk)), greatest(len(tk) - 1, 0)) as k from r2),
        r4 as (select line, case when regexp_matches(t, '^[A-Z][\\w/&.\\-]*(?:\\s+[A-Za-z][\\w/&.\\-]*){{0,4}}:\\s+\\S') then 'role' when len(tk) = 0 then 'statement' when list_contains({_l(T.STATEMENT_OPENERS)}, lower(tk[k + 1])) then 'statement' when list_contains({_l(T.IMPERATIVE_VERBS)}, lower(tk[k + 1])) then 'imperative'
          when list_contains({_l(T.PREDICATES)}, lower(coalesce(tk[k + 2], ''))) then 'statement' when list_contains({_l(T.DETERMINERS)}, lower(coalesce(tk[k + 2], ''))) then 'imperative' else 'statement' end as register from r3)
        select register, count(*) as lines, min(line) as first_line from r4 group by register""",
    "text_option_keys": f"select doc_id, sha256({_okey('text')}) as key_sha256 from documents",
    "text_content_words": f"select doc_id, len(w) as n_words, sha256(array_to_string(w, ' ')) as words_sha256, array_to_string(list_sort(list_distinct(list_filter(k, lambda x: list_contains({_l(T.POLARITY)}, x)))), ' ') as polarity from (select doc_id, {_tok('text')} as k, list_filter({_tok('text')}, lambda w: not list_contains({_l(T.STOPWORDS)}, w)) as w from documents)",
    "text_numbers": f"""{_w} select doc_id, line_no, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(line, '\\d+(?:[.,]\\d+)*'), lambda x: replace(x, ',', '')))), ' ') as numbers,
        array_to_string(list_sort(list_distinct(list_filter(flatten(list_transform(list_filter(regexp_extract_all(line, '[A-Za-z][\\w/\\-]*')[2:], lambda x: regexp_matches(x, '^[A-Z]')), lambda x: string_split({_norm('x')}, ' '))), lambda x: x <> '' and not list_contains({_l(T.STOPWORDS)}, x)))), ' ') as terms from lines""",
    "text_keys": f"select p_partkey, {_key} as document_key, left(sha256({_key} || '|q1|salt'), 32) as salt, sha256(left(sha256({_key} || '|q1|salt'), 32) || '|' || {_okey('p_type')}) as answer_hash, sha256({_key} || '|q1') as digest from part",
    "text_formats": """select p_partkey, replace(replace(replace(replace(replace('<b>' || p_name || '</b> & ''x'' "y"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as html, regexp_replace(lower(p_name || ' -- ' || p_brand), '[^a-z0-9]+', '_', 'g') as slug,
        case p_partkey % 3 when 0 then p_name when 1 then p_name || ' and ' || p_brand else p_name || ', ' || p_brand || ' and ' || p_type end as listed, case when p_partkey % 5 <= 2 then greatest(1, p_size // 2) else p_size end as points from part""",
    "text_durations_of_attempts": "select o_orderkey, printf('%04d:%02d:%02d.%02d', cs // 360000, cs % 360000 // 6000, cs % 6000 // 100, cs % 100) as timespan, printf('PT%dH%dM%.2fS', cs // 360000, cs % 360000 // 6000, (cs % 6000) / 100.0::double) as duration from (select o_orderkey, greatest(floor((o_orderkey * 37 % 100000 / 4.0 - 10) * 100), 0)::bigint as cs from orders)",
    "text_unicode_keys": f"select doc_id, sha256({_okey('text')}) as key_sha256 from documents",
    "content_sections": f"""{_w}, {Q.DEFS}, {Q.WARN}, {Q.STEPS}, n as (select doc_id, 'intro' as id, 1 as "order", 'Introduction' as title, 1 + (select count(*) from {Q._texts} x where x.doc_id = s.doc_id and section in ('purpose', 'scope')) + (select count(*) from {Q._resp} x where x.doc_id = s.doc_id)
          + regexp_matches(text, '{S.VERSION}')::int + regexp_matches(text, '{S.DATE}')::int as citations from sops s
        union all select doc_id, 'safety', 2, 'Safety and Precautions', count(*) from warnings group by doc_id union all select doc_id, 'definitions', 3, 'Key Terms and Definitions', count(*) from definitions group by doc_id
        union all select s.doc_id, 'procedures', 4, 'Procedure Steps', count(t.doc_id) from sops s left join steps t using (doc_id) group by s.doc_id
        union all select s.doc_id, 'summary', 5, 'Summary and Key Points', count(x.doc_id) from sops s left join (select doc_id from {Q._texts} where section = 'purpose') x using (doc_id) group by s.doc_id)
        select doc_id, id, title, "order", id = 'safety' as critical, citations from n""",
    "content_durations": f"{_w}, {Q.STEPS} select s.doc_id, greatest(5, floor(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) / 200 + (select count(*) from steps t where t.doc_id = s.doc_id) + 5)::bigint) as minutes from sops s",
    "content_definition_html": f"""{_w}, {Q.DEFS} select doc_id, '<h2>Key Terms and Definitions</h2>' || chr(10) || '<dl class=''definitions''>' || chr(10) || string_agg('<dt><strong>' || term || '</strong></dt>' || chr(10) || '<dd>' || definition || '</dd>', chr(10) order by ord) || chr(10) || '</dl>' as html from definitions group by doc_id""",
    "content_objectives": f"""{_w}, {Q.DEFS}, {Q.WARN}, {Q.STEPS}, tx as (select * from {Q._texts}), dn as (select *, count(*) over (partition by doc_id) as n from definitions),
        o1 as (select doc_id, 1 as rank, 'Explain why this procedure exists: ' || case when length(text) <= 100 then text else regexp_replace(left(text, 100), ' [^ ]*$', '') end as text, 'Understand' as level, 'purpose' as kind, s, e, null::varchar as step_number, null::varchar as term from tx where section = 'purpose'
        union all select doc_id, 2, 'Determine when this procedure applies and when it does not', 'Analyze', 'scope', s, e, null, null from tx where section = 'scope'
        union all select doc_id, 3, 'Identify each hazard in this procedure and the precaution it requires', 'Evaluate', 'safety', min(s), max(e), null, null from warnings group by doc_id
        union all select doc_id, 1000 + ord, 'Define ' || term, 'Remember', 'definition', line_no, line_no, null, term from dn where n <= 2
        union all select doc_id, 1001, 'Define the key terms used in this procedure: ' || array_to_string(list_sort(list({{'o': ord, 't': term}}))[:-2].list_transform(lambda x: x.t), ', ') || ' and ' || max_by(term, ord), 'Remember', 'definitions', min(line_no), max(line_no), null, null from dn where n > 2 group by doc_id),
        tk as (select doc_id, count(*) as taken from o1 group by doc_id),
        g0 as (select s.*, count(*) over (partition by s.doc_id) as n, greatest(1, 8 - coalesce(taken, 0)) as budget from steps s left join tk using (doc_id)),
        g1 as (select *, case when n <= budget then n else greatest(least(2, n), budget) end as groups from g0),
        g2 as (select *, n // groups as sz, n % groups as more from g1),
        g3 as (select *, case when ord - 1 < more * (sz + 1) then (ord - 1) // (sz + 1) else more + (ord - 1 - more * (sz + 1)) // sz end as g from g2),
        g4 as (select doc_id, g, count(*) as c, min_by(step_number, ord) as n1, max_by(step_number, ord) as n2, min_by(title, ord) as t1, max_by(title, ord) as t2, min_by(s, ord) as s, max_by(e, ord) as e from g3 group by doc_id, g),
        o2 as (select doc_id, 10 + g as rank, 'Perform ' || case when c = 1 then 'Step ' || n1 || ': ' || t1 else 'Steps ' || n1 || '–' || n2 || ': ' || t1 || ' … ' || t2 end as text, 'Apply' as level, 'step' as kind, s, e, case when c = 1 then n1 else n1 || '–' || n2 end as step_number, null as term from g4)
        select doc_id, row_number() over (partition by doc_id order by rank) as ord, text, level, kind, s, e, step_number, term from (select * from o1 union all select * from o2)""",
    "content_citation_coverage": f"""{_w}, {Q.DEFS}, {Q.WARN}, {Q.STEPS}, nl as (select doc_id, max(line_no) as n from lines group by doc_id),
        tx as (select * from {Q._texts}),
        has as (select d.doc_id, (select count(*) from tx x where x.doc_id = d.doc_id and section = 'purpose') as p, (select count(*) from tx x where x.doc_id = d.doc_id and section = 'scope') as q, (select count(*) from definitions x where x.doc_id = d.doc_id and term = 'E-Stop') as es,
          (select count(*) from steps x where x.doc_id = d.doc_id and step_number = '2') as s2, (select count(*) from steps x where x.doc_id = d.doc_id and step_number = '4.2') as s42, (select count(*) from steps x where x.doc_id = d.doc_id and step_number = '3') as s3, (select count(*) from warnings x where x.doc_id = d.doc_id and idx = 1) as w1, nl.n from sops d join nl using (doc_id)),
        items as (select doc_id, 'questions' as bucket, case when p > 0 then 'cited' else 'unresolvable' end as status from has where doc_id % 2 = 0 union all select doc_id, 'questions', case when q > 0 then 'cited' else 'unresolvable' end from has where doc_id % 2 = 1
          union all select doc_id, 'questions', case when es > 0 then 'cited' else 'unresolvable' end from has where doc_id % 3 = 0 union all select doc_id, 'questions', case when s2 > 0 then 'cited' else 'unresolvable' end from has where doc_id % 4 = 0
          union all select doc_id, 'questions', 'cited' from has where doc_id % 4 = 1 union all select doc_id, 'questions', case when s42 > 0 then 'cited' else 'unresolvable' end from has where doc_id % 4 = 2
          union all select doc_id, 'questions', case when s3 > 0 then 'cited' else 'unresolvable' end from has where doc_id % 5 = 0 union all select doc_id, 'questions', case when w1 > 0 then 'cited' else 'unresolvable' end from has where doc_id % 5 = 1 union all select doc_id, 'questions', 'not_grounded' from has where doc_id % 6 = 0
          union all select doc_id, 'sections', 'cited' from (select doc_id from {Q._title} union all select doc_id from {Q._match(S.VERSION, 'v')} union all select doc_id from {Q._match(S.DATE, 'v')} union all select doc_id from tx where section in ('purpose', 'scope') union all select doc_id from tx where section = 'purpose'
            union all select doc_id from {Q._resp} union all select doc_id from definitions union all select doc_id from warnings union all select doc_id from steps))
        select doc_id, coalesce(bucket, 'overall') as bucket, count(*) as total, count(*) filter (where status = 'cited') as cited, count(*) filter (where status = 'unresolvable') as unresolvable, count(*) filter (where status = 'not_grounded') as not_grounded, round_even(100.0 * cited / total::double, 1) as coverage_pct from items group by grouping sets ((doc_id, bucket), (doc_id))""",
    "content_reports": f"""{_w}, {Q.DEFS}, {Q.WARN}, {Q.STEPS}, tx as (select * from {Q._texts}) select d.doc_id, md5(text) as source_md5, title, (select count(*) from steps x where x.doc_id = d.doc_id) as steps, (select count(*) from warnings x where x.doc_id = d.doc_id) as warnings, (select count(*) from definitions x where x.doc_id = d.doc_id) as definitions,
        (select count(*) from {Q._resp} x where x.doc_id = d.doc_id) as responsibilities, case when d.doc_id % 10 = 0 then 'not_scanned' else 'none' end as risk, exists (select 1 from tx where tx.doc_id = d.doc_id and section = 'purpose') as has_purpose, exists (select 1 from tx where tx.doc_id = d.doc_id and section = 'scope') as has_scope from sops d left join {Q._title} t using (doc_id)""",
}
ORACLE_SQL["content_full_reports"] = f"""select doc_id, source_md5, 'not_scanned' as risk, coverage_pct, case when doc_id % 3 = 1 then p_brand when doc_id % 3 = 2 then '' end as approved_by, case when doc_id % 3 <> 0 then 'QA' end as role,
    case when doc_id % 3 <> 0 then '' end as approved_at, case when doc_id % 3 <> 0 then '' end as notes, case when doc_id % 3 <> 0 then (doc_id % 4)::int end as edits_count
    from (select doc_id, source_md5 from ({ORACLE_SQL["content_reports"]})) join (select doc_id, coverage_pct from ({ORACLE_SQL["content_citation_coverage"]}) where bucket = 'overall') using (doc_id) join part on p_partkey = doc_id"""
