"""Learning objectives, sections, citations and duration from a document's structure, and how well citations resolve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import structure as S

# Level and verb by kind, and limits.
BLOOM = {"definition": ("Remember", "Define"), "purpose": ("Understand", "Explain"), "scope": ("Analyze", "Determine"), "safety": ("Evaluate", "Identify"), "step": ("Apply", "Perform")}
MOST_OBJECTIVES = 8
WORDS_A_MINUTE = 200
SECTIONS = [("intro", "Introduction", 1), ("safety", "Safety and Precautions", 2), ("definitions", "Key Terms and Definitions", 3), ("procedures", "Procedure Steps", 4), ("summary", "Summary and Key Points", 5)]


def chunk(place: Column, count: Column, groups: Column) -> Column:
    """The contiguous near-equal group (from 0) of a place (from 0); the first ones get one more."""
    size, more = F.floor(count / groups), F.pmod(count, groups)
    head = more * (size + 1)
    return F.when(place < head, F.floor(place / (size + 1))).otherwise(more + F.floor((place - head) / size)).cast("long")


def step_label(title: Column, body: Column, most: int) -> Column:
    return F.when(T.strip(title) != "", T.strip(title)).otherwise(T.truncate(body, most))


def objectives(found: DataFrame) -> DataFrame:
    """(doc_id, ord from 1, text, level, kind, s, e, step_number, term) from `structure.found`: purpose, scope, safety, steps, definitions.

    Steps get what the others leave of eight, in contiguous near-equal groups where
    there are more; more than two definitions make one objective. All within the
    partitions that the findings come in.
    """
    kind, doc = F.col("kind"), W.partitionBy("doc_id")
    df = found.where(kind.isin(*BLOOM)).select("doc_id", "kind", "ord", "key", "number", "title", "text", "s", "e")
    count = lambda c: F.count_if(c).over(doc)
    df = df.withColumns({"_defs": count(kind == "definition"), "_steps": count(kind == "step"), "_safe": count(kind == "safety"), "_texts": count(kind.isin("purpose", "scope"))})
    taken = F.col("_texts") + F.least("_safe", F.lit(1)) + F.when(F.col("_defs") > 2, 1).otherwise(F.col("_defs"))
    df = df.withColumn("_left", F.greatest(F.lit(1), MOST_OBJECTIVES - taken))
    groups = F.when(F.col("_steps") <= F.col("_left"), F.col("_steps")).otherwise(F.greatest(F.least(F.lit(2), F.col("_steps")), F.col("_left")))
    rank = F.when(kind == "purpose", 1).when(kind == "scope", 2).when(kind == "safety", 3).when(kind == "step", 10 + chunk(F.col("ord") - 1, F.col("_steps"), groups)).when(F.col("_defs") <= 2, 1000 + F.col("ord")).otherwise(1001)
    ends = lambda f: f(F.struct("ord", "number", "title", "text"))
    terms = F.transform(F.array_sort(F.collect_list(F.when(kind == "definition", F.struct("ord", "key")))), lambda x: x["key"])
    df = df.withColumn("rank", rank.cast("long")).groupBy("doc_id", "rank", "kind").agg(ends(F.min).alias("a"), ends(F.max).alias("b"), terms.alias("terms"), F.min("s").alias("s"), F.max("e").alias("e"))
    one = F.col("a.ord") == F.col("b.ord")
    single = F.concat(F.lit("Step "), F.col("a.number"), F.lit(": "), step_label(F.col("a.title"), F.col("a.text"), 60))
    span = F.concat(F.col("a.number"), F.lit("–"), F.col("b.number"))
    ranged = F.concat(F.lit("Steps "), span, F.lit(": "), step_label(F.col("a.title"), F.col("a.text"), 40), F.lit(" … "), step_label(F.col("b.title"), F.col("b.text"), 40))
    what = (
        F.when(kind == "purpose", F.concat(F.lit("why this procedure exists: "), T.truncate(F.col("a.text"), 100))).when(kind == "scope", "when this procedure applies and when it does not").when(kind == "safety", "each hazard in this procedure and the precaution it requires")
        .when(kind == "step", F.when(one, single).otherwise(ranged)).when(one, F.col("terms")[0]).otherwise(F.concat(F.lit("the key terms used in this procedure: "), T.listed(F.col("terms"))))
    )
    level, verb = (F.coalesce(*[F.when(kind == k, v[i]) for k, v in BLOOM.items()]) for i in (0, 1))
    df = df.withColumn("ord", F.row_number().over(doc.orderBy("rank"))).where(F.col("ord") <= MOST_OBJECTIVES)
    number = F.when(kind == "step", F.when(one, F.col("a.number")).otherwise(span))
    named = F.when((kind == "definition") & ~one, "definitions").otherwise(kind)
    return df.select("doc_id", "ord", F.concat(verb, F.lit(" "), what).alias("text"), level.alias("level"), named.alias("kind"), "s", "e", number.alias("step_number"), F.when((kind == "definition") & one, F.col("terms")[0]).alias("term"))


def citations(provenance: DataFrame) -> DataFrame:
    """(doc_id, section, kind, s, e): what each section cites."""
    section = (
        F.when(F.col("kind").isin("title", "version", "effective_date", "purpose", "scope", "responsibilities"), F.lit("intro")).when(F.col("kind") == "safety", "safety").when(F.col("kind") == "definition", "definitions").when(F.col("kind") == "step", "procedures")
    )
    own = provenance.select("doc_id", section.alias("section"), "kind", "s", "e").where("section is not null")
    return own.union(provenance.where("kind = 'purpose'").select("doc_id", F.lit("summary"), "kind", "s", "e"))


def sections(found: DataFrame) -> DataFrame:
    """(doc_id, id, title, order, critical, citations) from `structure.found`: safety and definitions only where the document has them."""
    kind = F.col("kind")
    own = {"intro": kind.isin("title", "version", "effective_date", "purpose", "scope", "responsibilities"), "safety": kind == "safety", "definitions": kind == "definition", "procedures": kind == "step", "summary": kind == "purpose"}
    df = found.groupBy("doc_id").agg(*[F.count_if(c).alias(f"_{k}") for k, c in own.items()])
    row = lambda k, title, order: F.struct(F.lit(k).alias("id"), F.lit(title).alias("title"), F.lit(order).alias("order"), F.lit(k == "safety").alias("critical"), F.col(f"_{k}").alias("citations"))
    return df.select("doc_id", F.inline(F.array(*[row(*x) for x in SECTIONS]))).where("citations > 0 or id not in ('safety', 'definitions')")


def durations(docs: DataFrame, steps: DataFrame) -> DataFrame:
    """(doc_id, minutes): reading time, a minute a step and five for the assessment; five at least."""
    n = steps.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    words = F.size(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    return docs.join(n.hint("merge"), "doc_id", "left").select("doc_id", F.greatest(F.lit(5), F.floor(words / WORDS_A_MINUTE + F.coalesce("n", F.lit(0)) + 5)).cast("long").alias("minutes"))


def definition_html(defs: DataFrame) -> DataFrame:
    """(doc_id, html): the definitions section's markup, escaped."""
    item = F.concat(F.lit("<dt><strong>"), T.escaped(F.col("term")), F.lit("</strong></dt>\n<dd>"), T.escaped(F.col("definition")), F.lit("</dd>"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", item.alias("x")))), lambda x: x["x"]), "\n")
    return defs.groupBy("doc_id").agg(F.concat(F.lit("<h2>Key Terms and Definitions</h2>\n<dl class='definitions'>\n"), body, F.lit("\n</dl>")).alias("html"))


def bodies(found: DataFrame) -> DataFrame:
    """(doc_id, id, html): the markup of every section of `sections`, escaped; from `structure.found`."""
    kind, x = F.col("kind"), T.escaped(F.col("text"))
    df = found.withColumns({"kind": F.when(kind == "substep", "step").otherwise(kind), "_sub": kind == "substep"})
    kind = F.col("kind")
    subs = F.transform(F.array_sort(F.collect_list(F.when(F.col("_sub"), F.struct("ord", x.alias("x"))))), lambda r: F.concat(F.lit("<li>"), r["x"], F.lit("</li>")))
    own = lambda c: F.max(F.when(~F.col("_sub"), c))
    df = df.groupBy("doc_id", "kind", F.coalesce("of", "s").alias("at"), F.when(~kind.isin("step"), F.col("ord")).alias("nth")).agg(own(F.col("ord")).alias("ord"), own(F.col("key")).alias("key"), own(F.col("number")).alias("number"), own(T.strip(F.col("title"))).alias("title"), own(F.col("text")).alias("text"), subs.alias("subs"))
    label = F.concat(F.lit("<li><strong>Step "), T.escaped(F.col("number")), F.when(F.col("title") != "", F.concat(F.lit(": "), T.escaped(F.col("title")))).otherwise(""), F.lit("</strong>"))
    told = T.escaped(F.when(F.col("text") != "", F.col("text")).otherwise(F.col("title")))
    nested = F.when(F.size("subs") > 0, F.concat(F.lit("<ol type='a'>\n"), F.array_join("subs", "\n"), F.lit("\n</ol>")))
    item = (
        F.when(kind == "step", F.concat_ws("\n", label, F.when(told != "", F.concat(F.lit("<p>"), told, F.lit("</p>"))), nested, F.lit("</li>")))
        .when(kind == "definition", F.concat(F.lit("<dt><strong>"), T.escaped(F.col("key")), F.lit("</strong></dt>\n<dd>"), x, F.lit("</dd>")))
        .when(kind == "safety", F.concat(F.lit("<li><strong>WARNING:</strong> "), x, F.lit("</li>"))).when(kind == "responsibilities", F.concat(F.lit("<li>"), x, F.lit("</li>"))).otherwise(x)
    )
    of = lambda k: F.array_sort(F.collect_list(F.when(kind == k, F.struct("ord", item.alias("x"))))).alias(f"_{k}")
    kinds = ["responsibilities", "definition", "safety", "step"]
    once = ["title", "version", "effective_date", "purpose", "scope"]
    df = df.groupBy("doc_id").agg(*[of(k) for k in kinds], *[F.max(F.when(kind == k, x)).alias(k) for k in once], F.max(F.when(kind == "purpose", F.col("text"))).alias("aim"))
    listed = lambda k: F.array_join(F.transform(f"_{k}", lambda r: r["x"]), "\n")
    some = lambda k, *c: F.when(F.size(f"_{k}") > 0, F.concat(*c))
    n = lambda k: F.size(f"_{k}").cast("string")
    lines = lambda *c: F.concat_ws("\n", *[F.lit(y) if isinstance(y, str) else y for y in c])
    tagged = lambda k, a, b: F.when(F.col(k) != "", F.concat(F.lit(a), F.col(k), F.lit(b)))
    # The wording and tags of sections.
    html = {
        "intro": lines(
            F.concat(F.lit("<h2>Welcome to the Training Module: "), F.coalesce("title", F.lit("")), F.lit("</h2>")), tagged("version", "<p><strong>Version:</strong> ", "</p>"), tagged("effective_date", "<p><strong>Effective Date:</strong> ", "</p>"),
            tagged("purpose", "<h3>Purpose</h3><p>", "</p>"), tagged("scope", "<h3>Scope</h3><p>", "</p>"), some("responsibilities", F.lit("<h3>Responsibilities</h3><ul>\n"), listed("responsibilities"), F.lit("\n</ul>")),
        ),
        "safety": some("safety", F.lit("<h2>Safety and Precautions</h2>\n<div class='safety-alert'>\n<p><strong>⚠️ IMPORTANT:</strong> Please read and understand all safety warnings before proceeding.</p>\n</div>\n<ul class='safety-warnings'>\n"), listed("safety"), F.lit("\n</ul>")),
        "definitions": some("definition", F.lit("<h2>Key Terms and Definitions</h2>\n<dl class='definitions'>\n"), listed("definition"), F.lit("\n</dl>")),
        "procedures": lines("<h2>Procedure Steps</h2>", "<p>Follow these steps carefully to complete the procedure:</p>", "<ol class='procedure-steps'>", some("step", listed("step")), "</ol>"),
        "summary": lines(
            "<h2>Summary and Key Points</h2>", "<p>Let's review the key points from this training:</p>", "<ul class='key-points'>", F.when(F.col("aim") != "", F.concat(F.lit("<li>The purpose of this procedure is: "), T.escaped(T.truncate(F.col("aim"), 150)), F.lit("</li>"))),
            some("step", F.lit("<li>This procedure consists of "), n("step"), F.lit(" main steps</li>")), some("safety", F.lit("<li>There are "), n("safety"), F.lit(" critical safety warnings to remember</li>")), "</ul>",
            "<p><strong>Next:</strong> Complete the verification assessment to test your knowledge.</p>",
        ),
    }
    return df.select("doc_id", F.inline(F.array(*[F.struct(F.lit(k).alias("id"), v.alias("html")) for k, v in html.items()]))).where("html is not null")


def resolved(refs: DataFrame, provenance: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds status (cited, unresolvable, not_grounded) and the span that a question's reference comes to.

    ``refs``: doc_id, qid, kind, term, step_number, warning_index, s, e. A step's own span
    comes first, then its number; of steps with equal numbers the first counts.
    """
    key = F.when(F.col("kind").isin("purpose", "scope"), F.col("kind")).when(F.col("kind") == "definition", F.concat(F.lit("definition:"), F.col("term"))).when(F.col("kind").isin("step", "sequence"), F.concat(F.lit("step:"), F.col("step_number"))).when(F.col("kind").isin("safety", "safety_contradiction"), F.concat(F.lit("safety:"), F.col("warning_index").cast("string")))
    known = F.when(F.col("kind").isin("purpose", "scope"), F.col("kind")).when(F.col("kind") == "definition", F.concat(F.lit("definition:"), F.col("term"))).when(F.col("kind") == "step", F.concat(F.lit("step:"), F.col("term"))).when(F.col("kind") == "safety", F.concat(F.lit("safety:"), F.col("idx").cast("string")))
    spans = provenance.select("doc_id", known.alias("_key"), "idx", F.col("s").alias("ps"), F.col("e").alias("pe")).where("_key is not null").groupBy("doc_id", "_key").agg(F.min(F.struct("idx", "ps", "pe")).alias("p"))
    lines = docs.select("doc_id", F.size(F.split("text", "\n")).alias("_n"))
    df = refs.withColumn("_key", key).join(spans.hint("merge"), ["doc_id", "_key"], "left").join(lines.hint("merge"), "doc_id", "left")
    fine = lambda s, e: (s >= 1) & (s <= e) & (e <= F.col("_n"))
    own = (F.col("kind") == "step") & fine(F.col("s"), F.col("e"))
    s = F.when(own, F.col("s")).when(fine(F.col("p.ps"), F.col("p.pe")), F.col("p.ps"))
    e = F.when(own, F.col("e")).when(fine(F.col("p.ps"), F.col("p.pe")), F.col("p.pe"))
    return df.withColumns({"rs": s, "re": e}).withColumn("status", F.when(F.col("rs").isNotNull(), "cited").when(F.col("_key").isNotNull() | F.col("kind").isin("definition", "step", "sequence", "safety", "safety_contradiction"), "unresolvable").otherwise("not_grounded")).drop("_key", "_n", "p")


def coverage(items: DataFrame) -> DataFrame:
    """(doc_id, bucket, total, cited, unresolvable, not_grounded, coverage_pct) by bucket and, as ``overall``, by document; needs doc_id, bucket, status.

    One rollup gives both; an empty bucket has no row, its share would be 0. Shares are rounded to one place,
    halves to the even digit.
    """
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    df = items.rollup("doc_id", "bucket").agg(F.count(F.lit(1)).alias("total"), of("cited"), of("unresolvable"), of("not_grounded"), F.grouping_id().alias("g")).where("g < 3")
    return df.select("doc_id", F.when(F.col("g") == 1, "overall").otherwise(F.col("bucket")).alias("bucket"), "total", "cited", "unresolvable", "not_grounded", F.bround(100.0 * F.col("cited") / F.col("total"), 1).alias("coverage_pct"))


#: Fields of an approval with what stands for a missing one.
APPROVAL = {"approved_by": "", "role": "", "approved_at": "", "notes": "", "edits_count": 0}


def reports(docs: DataFrame, risks: DataFrame, verdicts: DataFrame | None = None, approvals: DataFrame | None = None, shares: DataFrame | None = None) -> DataFrame:
    """One row a document, from one pass over it: title, counts, what was found, scan risk (``not_scanned`` without one).

    With ``verdicts`` (doc_id, ok) the trail's state, with ``approvals`` (doc_id and any of
    APPROVAL, at most one a document) an approval block with defaults, null without an
    approval, with ``shares`` (the rows of `coverage`) the overall coverage_pct, 0 without
    citations.
    """
    number = lambda kind: F.count_if(F.col("kind") == kind)
    names = {"step": "steps", "safety": "warnings", "definition": "definitions", "responsibilities": "responsibilities"}
    found = S.found(docs.select("doc_id", "text"), source_md5=F.md5("text"))
    df = found.groupBy("doc_id").agg(
        F.max("doc.source_md5").alias("source_md5"), F.max(F.when(F.col("kind") == "title", F.col("text"))).alias("title"), *[number(k).alias(v) for k, v in names.items()], *[(number(k) > 0).alias(f"has_{k}") for k in ("purpose", "scope")],
    )
    df = df.join(risks.select("doc_id", "risk").hint("merge"), "doc_id", "left").withColumn("risk", F.coalesce("risk", F.lit("not_scanned")))
    if verdicts is not None:
        df = df.join(verdicts.select("doc_id", "ok").hint("merge"), "doc_id", "left").withColumn("trail", F.when(F.col("ok"), "intact").when(~F.col("ok"), "failed").otherwise("no_audit_trail")).drop("ok")
    if approvals is not None:
        own = F.struct(*[F.coalesce(F.col(k) if k in approvals.columns else F.lit(None), F.lit(v)).alias(k) for k, v in APPROVAL.items()])
        df = df.join(approvals.select("doc_id", own.alias("approval")).hint("merge"), "doc_id", "left")
    if shares is not None:
        df = df.join(shares.where("bucket = 'overall'").select("doc_id", "coverage_pct").hint("merge"), "doc_id", "left").withColumn("coverage_pct", F.coalesce("coverage_pct", F.lit(0.0)))
    return df
