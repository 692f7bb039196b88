"""Structure of procedure documents from their lines, with the span of every finding.

The operators of one kind work on `marked` lines; every window below has the document as
its key, so Spark keeps one exchange. `found` makes all kinds in one pass; of documents
that are dealt by their key already, nothing leaves its partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions.text import collapse, strip

# Headings and what they stand for, and the patterns of steps and markers.
ALIASES = {
    "purpose": "purpose", "objective": "purpose", "objectives": "purpose", "scope": "scope", "definitions": "definitions", "definition": "definitions", "key terms and definitions": "definitions",
    "responsibilities": "responsibilities", "responsibility": "responsibilities", "safety warnings": "safety", "safety": "safety", "warnings": "safety", "precautions": "safety", "safety precautions": "safety",
    "procedure": "procedure", "procedures": "procedure", "procedure steps": "procedure", "references": "references", "reference": "references", "documentation": "documentation", "records": "documentation", "revision history": "other",
}
NUMBERING = r"^(\d+(?:\.\d+)*)[.):]?\s+(.+)$"
STEPS = [r"(?i)^step\s+(\d+)\s*[:.\-]?\s*(.*)$", r"^(\d+\.\d+\.\d+)\.?\s+(.*)$", r"^(\d+\.\d+)\.?\s+(.*)$", r"^(\d+)[.):]\s*(.*)$"]
SUBSTEP = r"^\s*([a-z])[.)]\s+(.*)$"
NUMERIC_SUBSTEP = r"^\s*(\d+\.\d+\.\d+)\.?\s+(.*)$"
MARKER = r"(?i)^\s*(warning|caution|danger)\s*:\s*(.*)$"
STOP = r"(?i)^\s*(warning|caution|danger|note)\s*:"
BULLET = r"^[\-\*•‣◦⁃]\s*"
VERSION = r"(?i)version[:\s]+([0-9.]+)"
DATE = r"(?i)effective\s+date[:\s]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no from 1, line); a null text has no lines, an empty one has one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("p", "line")).select("doc_id", (F.col("p") + 1).alias("line_no"), "line")


def by_doc(*order: str) -> W:
    return W.partitionBy("doc_id").orderBy(*(order or ("line_no",)))


def marked(lines_: DataFrame) -> DataFrame:
    """Lines with ``body`` (stripped), ``heading`` (a section, ``other`` or null), ``strict`` (a known one), ``first`` (of its kind)."""
    edges = F.concat(F.left("line", F.lit(1)), F.right("line", F.lit(1)))
    body = F.when(edges.rlike(r"(?U)\s"), strip(F.col("line"))).otherwise(F.col("line"))  # most lines need no replacing
    rest = F.when(body.rlike(NUMBERING), strip(F.regexp_extract(body, NUMBERING, 2))).otherwise(body)
    bare = F.when(rest.endswith(":"), strip(F.expr("left(rest, length(rest) - 1)"))).otherwise(F.col("rest"))
    df = lines_.withColumn("body", body).withColumn("rest", rest).withColumn("bare", bare).withColumn("_low", F.when(F.length("bare") <= max(map(len, ALIASES)), F.lower("bare")))
    known = F.lit(None).cast("string")
    for section in dict.fromkeys(ALIASES.values()):
        known = F.when(F.col("_low").isin([a for a, to in ALIASES.items() if to == section]), section).otherwise(known)
    caps = (F.col("bare") == F.upper("bare")) & F.col("bare").rlike(r"\p{L}") & (F.size(F.split("bare", r"(?U)\s+")) <= 6)
    df = df.withColumn("_known", known).withColumn("heading", F.coalesce("_known", F.when(caps, "other"))).withColumn("strict", F.col("_known").isNotNull())
    # at most as many kinds as ALIASES has, so the set stays small; a row_number by kind would cost a second sort
    before = F.collect_set("heading").over(by_doc().rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("first", F.col("heading").isNotNull() & ~F.coalesce(F.array_contains(before, F.col("heading")), F.lit(False)))
    return df.drop("rest", "bare", "_low", "_known")


def in_sections(marked_: DataFrame) -> DataFrame:
    """Marked lines with ``section``: the first section of its kind whose body holds the line, else null."""
    last = F.last(F.when(F.col("heading").isNotNull(), F.struct("heading", "first")), ignorenulls=True).over(by_doc().rowsBetween(W.unboundedPreceding, 0))
    df = marked_.withColumn("_last", last)
    inside = F.col("heading").isNull() & F.col("_last.first") & (F.col("_last.heading") != "other")
    return df.withColumn("section", F.when(inside, F.col("_last.heading"))).drop("_last")


def section_texts(marked_: DataFrame) -> DataFrame:
    """(doc_id, section, text, s, e) of sections with text: its lines joined, and the span of those not blank."""
    body = in_sections(marked_).where("section is not null and body <> ''")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), " ")
    return body.groupBy("doc_id", "section").agg(collapse(joined).alias("text"), F.min("line_no").alias("s"), F.max("line_no").alias("e"))


def titles(marked_: DataFrame) -> DataFrame:
    """(doc_id, title, line_no): the first line not blank of the first ten."""
    return marked_.where("line_no <= 10 and body <> ''").groupBy("doc_id").agg(F.min_by("body", "line_no").alias("title"), F.min("line_no").alias("line_no"))


def line_at(text: Column, offset: Column) -> Column:
    """The line (from 1) of a character offset (from 1)."""
    head = F.substring(text, F.lit(1), offset - 1)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def matched(pattern: str) -> Column:
    """(text, s, e) of a text's first match, null without one: group 1 and the lines of the whole match."""
    at, hit = F.regexp_instr("text", F.lit(pattern)), F.regexp_extract("text", pattern.replace("(?i)", "(?i)(", 1) + ")", 1)
    s, e = line_at(F.col("text"), at), line_at(F.col("text"), F.greatest(at, at + F.length(hit) - 1))
    return F.when(F.col("text").rlike(pattern), F.struct(F.regexp_extract("text", pattern, 1).alias("text"), s.alias("s"), e.alias("e")))


def first_match(docs: DataFrame, pattern: str, name: str) -> DataFrame:
    """(doc_id, name, s, e): group 1 of the first match in the whole text, with its lines."""
    return docs.select("doc_id", matched(pattern).alias("m")).where("m is not null").select("doc_id", F.col("m.text").alias(name), "m.s", "m.e")


def fallback_text(docs: DataFrame, names: str) -> DataFrame:
    """(doc_id, text, s): for documents without the heading, what follows its name up to a paragraph's or capital line's end."""
    pattern = rf"(?is)(?:{names})[:\s]+(.*?)(?:\n\n|\n[A-Z]|\z)"
    head = F.regexp_extract("text", rf"(?is)^(.*?(?:{names})[:\s]+)(?:.*?)(?:\n\n|\n[A-Z]|\z)", 1)
    return docs.where(F.col("text").rlike(pattern)).select("doc_id", collapse(F.regexp_extract("text", pattern, 1)).alias("found"), line_at(F.col("text"), F.length(head) + 1).alias("s"))


def unbulleted() -> Column:
    return strip(F.regexp_replace("body", BULLET, ""))


def responsibilities(marked_: DataFrame) -> DataFrame:
    """(doc_id, idx from 0, text, line_no), bullets stripped."""
    df = in_sections(marked_).where("section = 'responsibilities' and body <> ''").withColumn("text", unbulleted()).where("text <> ''")
    return df.select("doc_id", (F.row_number().over(by_doc()) - 1).alias("idx"), "text", "line_no")


def term_and_definition() -> tuple[Column, Column]:
    """What stands before and after the first colon of ``body``, else the first spaced hyphen; nulls without either."""
    body = F.col("body")
    sep = F.when(body.contains(":"), F.lit(":")).when(body.contains(" - "), F.lit(" - "))
    at = F.instr(body, sep)
    return strip(F.substring(body, F.lit(1), at - 1)), strip(F.substring(body, at + F.length(sep), F.length(body)))


def split_definition(df: DataFrame) -> DataFrame:
    """Adds term and definition; rows without both fall away."""
    term, definition = term_and_definition()
    return df.withColumn("term", term).withColumn("definition", definition).where("term <> '' and definition <> ''")


def definitions(marked_: DataFrame) -> DataFrame:
    """(doc_id, ord from 1, term, definition, line_no): of a term's definitions the last, in the place of the first."""
    df = split_definition(in_sections(marked_).where("section = 'definitions'"))
    df = df.groupBy("doc_id", "term").agg(F.max_by("definition", "line_no").alias("definition"), F.max("line_no").alias("line_no"), F.min("line_no").alias("_first"))
    return df.select("doc_id", F.row_number().over(by_doc("_first")).alias("ord"), "term", "definition", "line_no")


def purpose_and_scope(docs: DataFrame, marked_: DataFrame) -> DataFrame:
    """(doc_id, section, text, s): the sections' texts; for documents without such a heading, what a phrase in the text introduces."""
    out = section_texts(marked_).where("section in ('purpose', 'scope')").select("doc_id", "section", "text", "s")
    for section, names in (("purpose", "purpose|objective"), ("scope", "scope")):
        headed = marked_.where((F.col("heading") == section) & F.col("first")).select("doc_id")
        loose = fallback_text(docs.join(headed.hint("merge"), "doc_id", "left_anti"), names).where("found <> ''")
        out = out.unionByName(loose.select("doc_id", F.lit(section).alias("section"), F.col("found").alias("text"), "s"))
    return out


def loose_definitions(docs: DataFrame, marked_: DataFrame) -> DataFrame:
    """(doc_id, ord, term, definition, line_no) of documents without the heading, from the block that the word introduces, up to a line that reads like a label."""
    pattern = r"(?is)definitions?\s*:?\s*\n(.*?)(?:\n[A-Z][A-Za-z /]*:|\z)"
    headed = marked_.where((F.col("heading") == "definitions") & F.col("first")).select("doc_id")
    rest = docs.join(headed.hint("merge"), "doc_id", "left_anti").where(F.col("text").rlike(pattern))
    before = F.regexp_extract("text", r"(?is)^(.*?definitions?\s*:?\s*\n)(?:.*?)(?:\n[A-Z][A-Za-z /]*:|\z)", 1)
    block = rest.select("doc_id", line_at(F.col("text"), F.length(before) + 1).alias("at"), F.posexplode(F.split(F.regexp_extract("text", pattern, 1), "\n")).alias("p", "line"))
    df = split_definition(block.select("doc_id", (F.col("at") + F.col("p")).alias("line_no"), strip(F.col("line")).alias("body")))
    df = df.groupBy("doc_id", "term").agg(F.max_by("definition", "line_no").alias("definition"), F.max("line_no").alias("line_no"), F.min("line_no").alias("_first"))
    return df.select("doc_id", F.row_number().over(by_doc("_first")).alias("ord"), "term", "definition", "line_no")


def warned_lines(marked_: DataFrame) -> DataFrame:
    """Marked lines with ``start`` (1 at a marker), ``run`` (null outside of warnings) and ``warning``, the line's share of the text."""
    starts = F.col("line").rlike(STOP) & F.col("line").rlike(MARKER)
    stops = (F.col("body") == "") | F.col("heading").isNotNull() | F.col("line").rlike(STOP)
    df = marked_.withColumn("start", starts.cast("int")).withColumn("brk", (stops | starts).cast("int"))
    upto = by_doc().rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("run", F.sum("brk").over(upto)).withColumn("warned", F.max(F.when(F.col("start") == 1, F.col("run"))).over(upto))
    part = F.when(F.col("start") == 1, strip(F.regexp_extract("line", MARKER, 2))).otherwise(F.col("body"))
    return df.withColumn("run", F.when(F.col("run") == F.col("warned"), F.col("run"))).withColumn("warning", F.when(F.col("run").isNotNull(), part)).drop("brk", "warned")


def warnings(marked_: DataFrame) -> DataFrame:
    """(doc_id, idx from 0, text, s, e): markers with the lines that continue them; of equal texts the first."""
    df = warned_lines(marked_).where("run is not null")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "warning"))), lambda x: x["warning"]), " ")
    out = df.groupBy("doc_id", "run").agg(collapse(joined).alias("text"), F.min("line_no").alias("s"), F.max("line_no").alias("e")).where("text <> ''")
    out = out.withColumn("n", F.row_number().over(W.partitionBy("doc_id", "text").orderBy("s"))).where("n = 1")
    return out.select("doc_id", (F.row_number().over(by_doc("s")) - 1).alias("idx"), "text", "s", "e")


def step_head(df: DataFrame) -> DataFrame:
    """Adds num and head of a step's heading by the first pattern that fits, else nulls."""
    num, head = (F.when(F.col("body").rlike(STEPS[0]), F.regexp_extract("body", STEPS[0], g)) for g in (1, 2))
    for p in STEPS[1:]:
        num, head = num.when(F.col("body").rlike(p), F.regexp_extract("body", p, 1)), head.when(F.col("body").rlike(p), F.regexp_extract("body", p, 2))
    maybe = F.col("body").rlike(r"(?i)^(?:step\s|\d)")  # what all patterns begin with
    return df.withColumn("num", F.when(maybe, num)).withColumn("head", F.when(maybe, strip(head)))


def step_lines(in_sections_: DataFrame) -> DataFrame:
    """Lines with ``is_step``, num and head of a step's heading, and ``step``: the line of the step they belong to, else null.

    Only the first procedure section has steps, or the whole document where there is none.
    """
    has = F.max(F.when((F.col("heading") == "procedure") & F.col("first"), F.lit(1))).over(W.partitionBy("doc_id"))
    df = in_sections_.withColumn("_has", has).withColumn("_in", F.col("_has").isNull() | F.coalesce(F.col("section") == "procedure", F.lit(False)))
    df = step_head(df).withColumn("num", F.when(F.col("_in"), F.col("num"))).withColumn("_strict", F.col("_in") & F.col("strict"))
    upto = by_doc().rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("level", F.length("num") - F.length(F.replace("num", F.lit("."), F.lit(""))))
    base = F.when(F.col("level") < 2, F.struct("line_no", "num"))
    wall = F.when((F.col("level") < 2) | F.col("_strict"), F.col("line_no"))
    df = df.withColumn("base", F.last(base, ignorenulls=True).over(upto)).withColumn("wall", F.last(wall, ignorenulls=True).over(upto))
    held = (F.col("level") == 2) & (F.col("wall") == F.col("base.line_no")) & (F.col("base.num") == F.regexp_extract("num", r"^(.*)\.[^.]*$", 1))
    df = df.withColumn("is_step", F.col("num").isNotNull() & ~F.coalesce(held, F.lit(False)))
    edge = F.when(F.col("is_step"), F.struct("line_no", F.lit(True).alias("on"))).when(F.col("_strict"), F.struct("line_no", F.lit(False).alias("on")))
    df = df.withColumn("edge", F.last(edge, ignorenulls=True).over(upto))
    return df.withColumn("step", F.when(F.col("_in") & F.col("edge.on"), F.col("edge.line_no"))).drop("_has", "_in", "_strict", "level", "base", "wall", "edge")


def procedure_lines(marked_: DataFrame) -> DataFrame:
    """The lines of steps, with ``step``: the line of the step they belong to."""
    return step_lines(in_sections(marked_)).where("step is not null")


def substeps(procedure: DataFrame) -> DataFrame:
    """(doc_id, step, sub from 1, text): lettered and three-level sub-steps with the lines that continue them."""
    df = procedure.where("not is_step")
    df = df.withColumn("is_sub", is_substep()).withColumn("sub", F.sum(F.col("is_sub").cast("int")).over(W.partitionBy("doc_id", "step").orderBy("line_no"))).where("sub > 0 and body <> ''")
    return df.groupBy("doc_id", "step", "sub").agg(collapse(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", _unmarked().alias("t")))), lambda x: x["t"]), " ")).alias("text"))


def is_substep() -> Column:
    return F.col("line").rlike(SUBSTEP) | F.col("line").rlike(NUMERIC_SUBSTEP)


def _unmarked() -> Column:
    return F.when(F.col("line").rlike(SUBSTEP), F.regexp_extract("line", SUBSTEP, 2)).when(F.col("line").rlike(NUMERIC_SUBSTEP), F.regexp_extract("line", NUMERIC_SUBSTEP, 2)).otherwise(F.col("line"))


def steps(marked_: DataFrame) -> DataFrame:
    """(doc_id, ord from 1, step_number, title, body, content, n_substeps, s, e) in the order of the document."""
    df = procedure_lines(marked_)
    own = F.col("is_step")
    text = F.transform(F.sort_array(F.collect_list(F.when(~own, F.struct("line_no", _unmarked().alias("t"))))), lambda x: x["t"])
    subs = is_substep()
    out = df.groupBy("doc_id", "step").agg(
        F.max(F.when(own, F.col("num"))).alias("step_number"), F.max(F.when(own, F.col("head"))).alias("title"), collapse(F.array_join(text, " ")).alias("body"),
        F.count_if(~own & subs).alias("n_substeps"), F.max(F.when(own | (F.col("body") != ""), F.col("line_no"))).alias("e"),
    )
    content = F.when(F.col("title") == "", F.col("body")).otherwise(strip(F.concat_ws("\n", "title", "body")))
    return out.select("doc_id", F.row_number().over(by_doc("step")).alias("ord"), "step_number", "title", "body", content.alias("content"), F.col("n_substeps").cast("long").alias("n_substeps"), F.col("step").alias("s"), "e")


def step_key(number: Column) -> Column:
    """Sorts step numbers naturally: dotted numbers first, each part by its value; others keep their order."""
    parts = F.filter(F.split(strip(number), r"[.\-_]"), lambda p: p != "")
    fine = (F.size(parts) > 0) & F.forall(parts, lambda p: strip(p).rlike(r"^\d+[A-Za-z]*$"))
    key = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^\s*(\d+)", 1).cast("long").alias("n"), F.lower(F.regexp_extract(p, r"([A-Za-z]*)\s*$", 1)).alias("s")))
    return F.struct((~fine).alias("odd"), F.when(fine, key).alias("key"))


#: Lines that a join of spans moves together.
BLOCK = 16


def cited(spans: DataFrame, docs: DataFrame, context: int = 0) -> DataFrame:
    """The rows of ``spans`` (doc_id, s, e and others) with ``excerpt``: their lines with so many more on either side, null where a span isn't within its document.

    Ends that come in the wrong order are exchanged. A join of blocks of BLOCK lines with
    the blocks that spans reach into: each distinct span meets no more lines than it has
    and two blocks hold, however long its document is. Lines are many times what Spark takes
    texts made of short rows for, so they are merged, never sent whole to all tasks.
    """
    a, b = F.least("s", "e"), F.greatest("s", "e")
    asked = spans.select("doc_id", "s", "e").where("s is not null and e is not null").distinct().select("doc_id", "s", "e", b.alias("_end"), F.greatest(a - context, F.lit(1)).alias("_a"), (b + context).alias("_b")).where(a >= 1)
    # a span beyond its document meets no block, however far it reaches
    asked = asked.join(docs.select("doc_id", F.size(F.split("text", "\n")).alias("_n")).hint("merge"), "doc_id").where("_end <= _n")
    asked = asked.select("*", F.explode(F.expr(f"sequence((_a - 1) div {BLOCK}, (least(_b, _n) - 1) div {BLOCK})")).alias("block"))
    own = docs.select("doc_id", F.split("text", "\n").alias("_l")).where("_l is not null")
    cut = F.transform(F.sequence(F.lit(0), F.expr(f"cast((size(_l) - 1) div {BLOCK} as int)")), lambda i: F.slice("_l", i * BLOCK + 1, F.lit(BLOCK)))
    blocks = own.select("doc_id", F.posexplode(cut).alias("block", "_part")).withColumn("block", F.col("block").cast("long"))
    first, last = F.greatest(F.col("_a") - F.col("block") * BLOCK, F.lit(1)).cast("int"), F.least(F.col("_b") - F.col("block") * BLOCK, F.size("_part")).cast("int")
    met = asked.join(blocks.hint("merge"), ["doc_id", "block"]).select("doc_id", "s", "e", "block", F.when(last >= first, F.array_join(F.slice("_part", first, last - first + 1), "\n")).alias("_t"))
    parts = F.transform(F.sort_array(F.collect_list(F.when(F.col("_t").isNotNull(), F.struct("block", "_t")))), lambda x: x["_t"])
    texts = met.groupBy("doc_id", "s", "e").agg(F.array_join(parts, "\n").alias("excerpt"))
    return spans.join(texts.hint("merge"), ["doc_id", "s", "e"], "left").select(*[spans[c] for c in spans.columns], "excerpt")


def excerpts(docs: DataFrame, spans: DataFrame, context: int = 0) -> DataFrame:
    """(doc_id, s, e, excerpt): the lines of each span with context; spans outside the document fall away."""
    return cited(spans.select("doc_id", "s", "e"), docs, context).where("excerpt is not null")


def found(docs: DataFrame, **own: Column) -> DataFrame:
    """All that is found in the documents, in one pass, a row a finding; documents dealt by doc_id, in as many parts as there is work for, are not exchanged again.

    (doc_id, kind, ord from 1 within its kind, key: a definition's term, number and title of
    a step, text, n_substeps, of: the line of a sub-step's step, s, e, doc). Kinds: title,
    version, effective_date, purpose, scope, responsibilities, definition, safety, step,
    substep and, once for every document (a null text has no other row), document. ``doc``
    holds n_lines and the columns ``own`` of ``docs``, on the row ``document`` alone.
    """
    facts = F.struct(matched(VERSION).alias("version"), matched(DATE).alias("date"), F.size(F.split("text", "\n")).alias("n_lines"), *[c.alias(k) for k, c in own.items()])
    df = docs.select("doc_id", "text", facts.alias("doc")).select("doc_id", "doc", F.posexplode_outer(F.split("text", "\n")).alias("p", "line"))
    p = F.coalesce("p", F.lit(0))
    df = step_lines(in_sections(warned_lines(marked(df.select("doc_id", (p + 1).alias("line_no"), "line", F.when(p == 0, F.col("doc")).alias("doc"))))))
    sub = F.coalesce(F.col("step").isNotNull() & ~F.col("is_step") & is_substep(), F.lit(False))
    df = df.withColumn("sub", sub).withColumn("subline", F.last(F.when(F.col("sub"), F.col("line_no")), ignorenulls=True).over(by_doc().rowsBetween(W.unboundedPreceding, 0)))
    term, definition = term_and_definition()
    # columns of their own, as the rows below name them more than once
    of_section = lambda name, c: F.when(F.col("section") == name, c)
    df = df.withColumns({"term": of_section("definitions", term), "definition": of_section("definitions", definition), "duty": of_section("responsibilities", unbulleted()), "told": F.when(F.col("step").isNotNull(), _unmarked())})
    body, line_no, full = F.col("body"), F.col("line_no"), F.col("body") != ""
    none, zero = F.lit(None), F.lit(0)

    def row(kind, on, text=none, at=zero, key=none, of=none, s=line_no, e=line_no):
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.when(on, F.struct(kind.alias("kind"), at.cast("long").alias("at"), key.cast("string").alias("key"), text.cast("string").alias("t"), of.cast("int").alias("of"), s.cast("int").alias("s"), e.cast("int").alias("e")))

    fact = lambda kind, name: row(kind, F.col(f"doc.{name}").isNotNull(), F.col(f"doc.{name}.text"), s=F.col(f"doc.{name}.s"), e=F.col(f"doc.{name}.e"))
    rows = F.array(
        row("document", F.col("doc").isNotNull(), e=F.col("doc.n_lines")), fact("version", "version"), fact("effective_date", "date"), row("title", (line_no <= 10) & full, body), row(F.col("section"), F.col("section").isin("purpose", "scope") & full, body),
        row("responsibilities", F.col("duty") != "", F.col("duty"), line_no),
        row("definition", (F.col("term") != "") & (F.col("definition") != ""), F.col("definition"), key=F.col("term")),
        row("safety", F.col("run").isNotNull(), F.col("warning"), F.col("run")), row("step", F.col("step").isNotNull(), F.when(~F.col("is_step"), F.col("told")), F.col("step"), e=F.when(F.col("is_step") | full, line_no)),
        row("substep", (F.col("subline") > F.col("step")) & full, F.col("told"), F.col("subline"), of=F.col("step")),
    )
    df = df.select("doc_id", "line_no", "doc", "is_step", "num", "head", "sub", F.explode(rows).alias("r")).where("r is not null").select("*", "r.*")
    parts, own_line = F.sort_array(F.collect_list(F.struct("line_no", "t"))), F.col("is_step") & (F.col("kind") == "step")
    df = df.groupBy("doc_id", "kind", "at", "key").agg(
        parts.alias("parts"), F.max(F.when(own_line, F.col("num"))).alias("number"), F.max(F.when(own_line, F.col("head"))).alias("title"), F.count_if("sub").alias("n_substeps"), F.max("of").alias("of"), F.min("s").alias("s"), F.max("e").alias("e"),
        F.min("line_no").alias("first"), F.any_value(F.when(F.col("kind") == "document", F.col("doc")), ignoreNulls=True).alias("doc"),
    )
    one, last = F.col("kind").isin("title", "version", "effective_date", "responsibilities"), F.col("kind") == "definition"
    text = F.when(one, F.col("parts")[0]["t"]).when(last, F.element_at("parts", -1)["t"]).otherwise(collapse(F.array_join(F.transform("parts", lambda x: x["t"]), " ")))
    df = df.withColumns({"text": text, "s": F.when(last, F.col("e")).otherwise(F.col("s")), "e": F.when(F.col("kind") == "title", F.col("s")).otherwise(F.col("e"))})
    same = F.row_number().over(W.partitionBy("doc_id", "kind", "text").orderBy("s"))
    df = df.withColumn("_same", same).where("kind <> 'safety' or (text <> '' and _same = 1)")
    df = df.withColumn("ord", F.row_number().over(W.partitionBy("doc_id", "kind").orderBy("first")))
    return df.select("doc_id", "kind", "ord", "key", "number", "title", "text", F.when(F.col("kind") == "step", F.col("n_substeps")).alias("n_substeps"), "of", "s", "e", "doc")


def provenance(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, idx, term, s, e): one row a span of everything that is found in the documents."""
    df = found(docs).where("kind not in ('document', 'substep')")
    return df.select("doc_id", "kind", (F.col("ord") - 1).cast("int").alias("idx"), F.coalesce("key", "number").alias("term"), "s", "e")
