"""Queries of grounding, and the SQL that each equals."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import grounding as G
from vellum.operators import quiz as Z
from vellum.operators import structure as S
from vellum.plans import quiz_queries as K
from vellum.plans import structure_queries as Q
from vellum.plans import synth

#: Claims on the lines of the procedure documents: as they stand, with a clause or number added, or made up; some cite lines that don't exist.
CLAIM = """case (doc_id + line_no) % 6 when 0 then line || ' and then call the fire department' when 1 then line when 2 then line || ' Wait 42.5 minutes, 1,200 times.'
  when 3 then 'Completely unrelated statement about Nothing else here today' when 4 then '' else 'Check the label of the ' || line end"""
SPAN = "case when (doc_id + line_no) % 11 = 0 then 9999 else line_no end"


def claims(spark, sf_dir):
    docs = Q.sops(spark, sf_dir)
    df = S.lines(docs).where("line <> ''").select("doc_id", F.col("line_no").alias("cid"), F.expr(CLAIM).alias("text"), F.col("line_no").alias("s"), F.expr(SPAN).alias("e"))
    out = G.verified(df, docs)
    return out.select("doc_id", "cid", "ok", F.array_join("reasons", "; ").alias("reasons"), "overlap", F.array_join("unsupported", " ").alias("unsupported"), F.array_join("added", " ").alias("added"))


def distractors(spark, sf_dir):
    """Altered warnings and other lines as wrong options next to a warning."""
    docs = Q.sops(spark, sf_dir)
    w = S.warnings(S.marked(S.lines(docs)))
    df = w.select("doc_id", F.col("idx").alias("cid"), F.coalesce(T.altered(F.col("text")), F.col("text")).alias("text"), F.lit("Wear gloves at all times in the press area.").alias("correct"))
    return G.distractors(df, docs)


def proposals(spark, sf_dir):
    """What becomes of proposals for objectives, by document."""
    q = synth.view(spark, sf_dir, synth.QUESTIONS)
    targets = q.where("ord % 3 <> 0").select("doc_id", F.lit("objectives").alias("task"), "id").withColumnRenamed("id", "target")
    df = q.select("doc_id", F.lit("objectives").alias("task"), F.when(F.col("ord") % 4 == 0, "q1").otherwise(F.col("id")).alias("target"), "ord", (F.col("pick") % 2 == 0).alias("ok"))
    return G.applied(df, targets).select("doc_id", "ord", "target", "status")


def reverted(spark, sf_dir):
    q = synth.view(spark, sf_dir, synth.QUESTIONS)
    worst = Z.worst_strategy(Z.naive_scores(q, K.lengths()), 70.0)
    df = q.select("doc_id", F.lit("distractors").alias("task"), F.col("id").alias("target"), "ord", (F.col("pick") % 3 > 0).alias("ok"))
    out = G.reverted(G.applied(df, df), worst)
    return out.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def by_task(spark, sf_dir):
    q = synth.view(spark, sf_dir, synth.QUESTIONS)
    df = q.select("doc_id", F.when(F.col("ord") % 2 == 0, "summaries").otherwise("objectives").alias("task"), F.col("id").alias("target"), "ord", (F.col("pick") % 3 > 0).alias("ok"))
    return G.by_task(G.applied(df, df))


def summaries(spark, sf_dir):
    """What becomes of proposed summaries: the order's first questions are the sentences of one, by threes."""
    q = synth.view(spark, sf_dir, synth.QUESTIONS)
    sentences = q.select("doc_id", F.concat(F.lit("s"), (F.col("ord") % 2).cast("string")).alias("target"), F.lit(1).alias("ord"), F.col("ord").alias("pos"), (F.col("pick") % 5 > 0).alias("ok"))
    found = G.summaries(sentences)
    return G.applied(found, found.where("doc_id % 9 > 0")).select("doc_id", "target", "status")


def _calls(spark, sf_dir):
    q = synth.view(spark, sf_dir, synth.QUESTIONS)
    usage = F.create_map(F.lit("input_tokens"), F.col("l_partkey").cast("string"), F.lit("output_tokens"), F.col("pick").cast("string"), F.lit("model"), F.lit("none"))
    return q.select("doc_id", F.col("ord").alias("call"), usage.alias("usage"), F.when(F.col("pick") % 7 == 0, F.concat(F.lit("failed "), F.col("id"))).when(F.col("pick") % 7 == 1, "").alias("error"))


def token_usage(spark, sf_dir):
    return G.token_usage(_calls(spark, sf_dir))


def errors(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return G.errors(G.merged([calls.where("call % 2 = 0"), calls.where("call % 2 = 1")]))


def merged_notes(spark, sf_dir):
    q = synth.view(spark, sf_dir, synth.QUESTIONS)
    return G.merged_notes(q.select(F.col("doc_id").alias("report"), "ord", F.concat(F.lit("note "), (F.col("l_partkey") % 50).cast("string")).alias("note")))


QUERIES = {f"grounding_{f.__name__}": f for f in (claims, proposals, reverted, by_task, distractors, summaries, token_usage, errors, merged_notes)}

_l = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_norm = lambda x: f"trim(regexp_replace(regexp_replace(lower({x}), '[^\\pL\\pN_\\s%]+', ' ', 'g'), '\\s+', ' ', 'g'))"
_content = lambda x: f"list_filter(string_split(regexp_replace(' ' || replace({_norm(x)}, ' ', '  ') || ' ', ' (?:{'|'.join(T.STOPWORDS)}) ', ' ', 'g'), ' '), lambda w: w <> '')"
_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_nums = lambda x: f"list_transform(regexp_extract_all({x}, '\\d+(?:[.,]\\d+)*'), lambda n: replace(n, ',', ''))"
_terms = f"list_filter(flatten(list_transform(list_filter(regexp_extract_all(t, '[A-Za-z][\\w/\\-]*')[2:], lambda x: regexp_matches(x, '^[A-Z]')), lambda x: string_split({_norm('x')}, ' '))), lambda x: x <> '' and not list_contains({_l(T.STOPWORDS)}, x))"
_q = f"with q as ({synth.QUESTIONS})"
ORACLE_SQL = {
    "grounding_summaries": f"{_q} select doc_id, 's' || (ord % 2) as target, case when doc_id % 9 = 0 then 'unknown target' when count(*) between 2 and 4 and bool_and(pick % 5 > 0) then 'accepted' else 'rejected' end as status from q group by doc_id, ord % 2",
    "grounding_token_usage": f"{_q} select doc_id, 'input_tokens' as key, sum(l_partkey)::bigint as tokens from q group by doc_id union all select doc_id, 'output_tokens', sum(pick)::bigint from q group by doc_id",
    "grounding_errors": f"{_q} select doc_id, ord as call, 'failed ' || id as error from q where pick % 7 = 0",
    "grounding_merged_notes": f"{_q}, n as (select 'note ' || (l_partkey % 50) as note, min((doc_id, ord)) as met from q group by 1) select note, row_number() over (order by met) as place from n",
    "grounding_claims": f"""with {Q.MARKED}, c0 as (select doc_id, line_no as cid, trim({CLAIM}) as t, line_no as s, {SPAN} as e from lines where line <> ''), nl as (select doc_id, list(line order by line_no) as a, list(ws order by line_no) as aw from (select doc_id, line_no, line, {_content('line')} as ws from lines) group by doc_id),
        c1 as (select c0.*, s <= e and e <= len(a) as fine, case when s <= e and e <= len(a) then array_to_string(a[greatest(s - 1, 1):e + 1], chr(10)) else '' end as x, case when s <= e and e <= len(a) then list_distinct(flatten(aw[greatest(s - 1, 1):e + 1])) else [] end as known from c0 join nl using (doc_id)),
        c2 as (select *, {_content('t')} as words, {_terms} as terms from c1),
        k1 as (select doc_id, cid, known, generate_subscripts(p, 1) as clause, unnest(p) as c from (select *, regexp_split_to_array(t, '[;:,.!?()\\[\\]–—]|\\s-\\s') as p from c2)),
        k2 as (select doc_id, cid, known, clause, generate_subscripts(p, 1) as pos, unnest(p) as w from (select *, string_split({_norm('c')}, ' ') as p from k1) where list_has_any(p, [{_in(T.CONNECTIVES).strip('()')}])),
        k3 as (select *, w in {_in(T.CONNECTIVES)} as opens, sum((w in {_in(T.CONNECTIVES)})::int) over (partition by doc_id, cid, clause order by pos) as run from k2 where w <> ''),
        k4 as (select doc_id, cid, clause, run, list(w order by pos) as ws, bool_or(list_contains(known, w)) as held from k3 where run > 0 and not opens and w not in {_in(T.STOPWORDS)} group by all),
        k5 as (select doc_id, cid, w, min(o) as o from (select doc_id, cid, unnest(ws) as w, clause * 1000000 + run * 1000 + generate_subscripts(ws, 1) as o from k4 where not held) group by all),
        k6 as (select doc_id, cid, string_agg(w, ' ' order by o) as added from k5 group by all),
        c3 as (select c2.*, coalesce(added, '') as added, case when len(words) > 0 then len(list_filter(words, lambda w: list_contains(known, w))) / len(words) else 0 end as overlap,
          list_filter(list_transform(range(1, len(words) + 1), lambda i: case when not list_contains(known, words[i]) and list_position(words, words[i]) = i then words[i] end), lambda w: w is not null) as un from c2 left join k6 using (doc_id, cid)),
        c4 as (select *, case when t = '' then ['empty'] when not fine then list_filter([case when length(t) > 300 then 'too long' end, 'span'], lambda r: r is not null)
          else list_filter([case when length(t) > 300 then 'too long' end, case when len(list_filter({_nums('t')}, lambda n: not list_contains({_nums('x')}, n))) > 0 then 'numbers' end, case when len(words) = 0 then 'no content words' end,
            case when overlap < {G.OVERLAP} and not (len(terms) > 0 and len(list_filter(terms, lambda w: not list_contains(known, w))) = 0) then 'overlap' end, case when len(un) > {G.UNSUPPORTED} then 'unsupported words' end, case when added <> '' then 'added clause' end], lambda r: r is not null) end as r from c3)
        select doc_id, cid, len(r) = 0 as ok, array_to_string(r, '; ') as reasons, overlap, array_to_string(un, ' ') as unsupported, added from c4""",
    "grounding_proposals": f"{_q}, p as (select doc_id, ord, case when ord % 4 = 0 then 'q1' else id end as target, pick % 2 = 0 as ok from q), n as (select *, row_number() over (partition by doc_id, target order by ord) as k from p) select doc_id, ord, target, case when not exists (select 1 from q where q.doc_id = n.doc_id and q.id = n.target and q.ord % 3 <> 0) then 'unknown target' when k > 1 then 'duplicate' when ok then 'accepted' else 'rejected' end as status from n",
    "grounding_reverted": f"{_q}, {K._all}, {K._scores}, g as (select doc_id, max(score) >= 70 as gameable from scores group by doc_id) select case when pick % 3 > 0 and gameable then 'reverted' when pick % 3 > 0 then 'accepted' else 'rejected' end as status, count(*) as n from q join g using (doc_id) group by 1",
    "grounding_by_task": f"{_q} select case when ord % 2 = 0 then 'summaries' else 'objectives' end as task, count(*) filter (where pick % 3 > 0) as accepted, count(*) filter (where pick % 3 = 0) as rejected, count(*) as total from q group by 1",
}
