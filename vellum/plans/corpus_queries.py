"""Queries over whole corpora and over requests and packages, and the SQL of those that SQL can say."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import assessment as A
from vellum.operators import generation as G
from vellum.operators import quiz as Z
from vellum.operators import structure as S
from vellum.operators import validation as V
from vellum.plans import scan_queries as C
from vellum.plans import structure_queries as Q
from vellum.plans import text_queries as X
from vellum.sources import packages as P
from vellum.sources import sinks
from vellum.sources.shared import stored


def questions(spark, sf_dir):
    """The questions of every procedure document, options laid out."""
    q = A.placed(stored(A.assessments(A.facts(Q.sops(spark, sf_dir)), (5,), (True,)), "questions"))  # made once, for the layout and the join
    return q.select("doc_id", "ord", "id", "category", "type", "text", F.to_json("options").alias("options"), "correct_answer", "points", "answer_hash")


def _swept(spark, sf_dir):
    docs = Q.sops(spark, sf_dir)
    found = C._scanned(docs).withColumn("severity", F.when(F.col("kind").isin(*C.R.HIGH_KINDS), "high").otherwise("low"))
    return A.sweep(docs, C.C.risks(docs, found), (5, 8))


def sweep(spark, sf_dir):
    return _swept(spark, sf_dir)


def sweep_totals(spark, sf_dir):
    return Z.sweep(stored(_swept(spark, sf_dir), "sweep"))


def requests(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k = F.col("o_orderkey")
    n = F.when(k % 31 == 0, "ten").otherwise((k % 25).cast("string"))
    df = o.select(k.alias("id"), V.request_error(n, (40 + k % 70).cast("string"), F.when(k % 7 == 0, "exe").otherwise("scorm"), F.when(k % 5 == 0, "3").otherwise("2004")).alias("error"))
    return df.groupBy(F.coalesce("error", F.lit("-")).alias("error")).agg(F.count(F.lit(1)).alias("requests"))


def edited_records(spark, sf_dir):
    """The first fault of edited assessments, by kind."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey")
    q = lambda i: F.struct(F.when((k % 11 == 0) & F.lit(i == 3), "q1").otherwise(f"q{i}").alias("id"), F.when((k % 13 == 0) & F.lit(i == 2), " ").otherwise(F.col("p_name")).alias("text"), F.when(k % 7 == 0, F.array(F.lit("A"), F.lit(" a "))).otherwise(F.array(F.lit("A"), "p_brand")).alias("options"), F.when(k % 5 == 0, 2).otherwise(1).alias("correct_answer"))
    qs = F.array(*[q(i) for i in range(1, 6)])
    r = F.struct((k % 120).cast("int").alias("passing_score"), F.when(k % 17 == 0, F.slice(qs, 1, 4)).otherwise(qs).alias("questions"))
    return p.select(F.coalesce(V.assessment_error(r), F.lit("-")).alias("error")).groupBy("error").agg(F.count(F.lit(1)).alias("records"))


def manifests(spark, sf_dir):
    return sinks.manifest(G.sections(S.found(Q.sops(spark, sf_dir))))


def package_manifests(spark, sf_dir):
    """Manifests of both versions; every third module is medical."""
    found = stored(S.found(Q.sops(spark, sf_dir)), "found")
    titles = found.groupBy("doc_id").agg(F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title"))
    modules = titles.withColumn("passing_score", F.when(F.col("doc_id") % 3 == 0, Z.PASS_MARKS[True]).otherwise(Z.PASS_MARKS[False]))
    return P.package_manifests(modules, G.sections(found)).select("doc_id", "version", F.md5("manifest").alias("manifest_md5"))


QUERIES = {f"corpus_{f.__name__}": f for f in (requests, edited_records, manifests, package_manifests, questions, sweep, sweep_totals)}

ORACLE_SQL = {
    "corpus_requests": "select case when o_orderkey % 31 = 0 then 'not integers' when o_orderkey % 25 not between 5 and 20 then 'questions out of range' when 40 + o_orderkey % 70 not between 50 and 100 then 'passing score out of range' when o_orderkey % 7 = 0 then 'output format' when o_orderkey % 5 = 0 then 'version' else '-' end as error, count(*) as requests from orders group by 1",
    "corpus_edited_records": "select case when p_partkey % 120 not between 1 and 100 then 'passing score' when p_partkey % 17 = 0 then 'too few questions' when p_partkey % 7 = 0 then 'equal options' when p_partkey % 5 = 0 then 'correct answer' when p_partkey % 13 = 0 then 'question without text' when p_partkey % 11 = 0 then 'id used twice' else '-' end as error, count(*) as records from part group by 1",
    "corpus_manifests": "with s as (" + X.ORACLE_SQL["content_sections"] + ") select doc_id, 'item_' || id as item, 'res_' || id as resource, id || '.html' as file, \"order\" as ord, '1.2' as schema_version from s union all select distinct doc_id, 'item_assessment', 'res_assessment', 'assessment.html', 99, '1.2' from s",
}


def _manifest_sql(version: str) -> str:
    """The manifest of one version from title, pages (titles) and mark."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    item = """'<item identifier="ITEM-' || i || '" identifierref="RES-' || i || '" isvisible="true"><title>' || pages[i] || '</title></item>'"""
    page = q(P.resource(version, "\0", "content_\0.html")).replace("\0", "' || i || '")
    each = lambda x: f"coalesce(array_to_string(list_transform(range(1, len(pages) + 1), lambda i: {x}), ''), '')"
    mark = "'<adlcp:masteryscore>' || mark || '</adlcp:masteryscore></item>'"
    if version == "2004":
        mark = """'<imsss:sequencing><imsss:objectives><imsss:primaryObjective objectiveID="OBJ-ASSESSMENT" satisfiedByMeasure="true"><imsss:minNormalizedMeasure>0.' || mark || '00</imsss:minNormalizedMeasure></imsss:primaryObjective></imsss:objectives></imsss:sequencing></item><imsss:sequencing><imsss:controlMode choice="true" flow="true"/></imsss:sequencing>'"""
    test = """'<item identifier="ITEM-ASSESSMENT" identifierref="RES-ASSESSMENT" isvisible="true"><title>Assessment</title>'"""
    return f"""{q(P.opening(version))} || title || '</title>' || {each(item)} || {test} || {mark} || '</organization></organizations><resources>' || {each(page)} || {q(P.closing(version))}"""


ORACLE_SQL["corpus_package_manifests"] = f"""with s as ({X.ORACLE_SQL["content_sections"]}), p as (select doc_id, list(title order by "order") as pages, case when doc_id % 3 = 0 then 80 else 70 end as mark from s where citations > 0 or id in ('intro', 'procedures', 'summary') group by doc_id),
    t as (select doc_id, title from ({X.ORACLE_SQL["content_reports"]}))
    select doc_id, version, md5(case version when '1.2' then {_manifest_sql("1.2")} else {_manifest_sql("2004")} end) as manifest_md5 from p join t using (doc_id), (values ('1.2'), ('2004')) as v(version)"""
