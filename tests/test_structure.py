"""Structure of documents: headings, definitions, warnings, steps and their spans."""

from pyspark.sql import functions as F

from vellum.operators import structure as S

A = """Press Line SOP

Version: 2.1.
Effective  Date: 3/14/2024
1.0 PURPOSE
Keep the   press
 safe.

SCOPE:
All sites.
DEFINITIONS:
Emergency Shutdown (E-Stop): halts all
Lockout/Tagout - isolation
Lockout/Tagout - energy isolation
RESPONSIBILITIES:
- Operator: check
• Lead: approve
WARNING: Never reach in
while running.
NOTE: dry hands
warning: never reach in
WARNING: Never reach in while  running.
PROCEDURE:
Step 1: Stop
Press the button.
a. Wait
for it
b) Lock

Tag it.
Step 2 - Start
5.1 Odd
5.1.1 inner
5.1.2 inner two
6.1.1 orphan
body
REFERENCES:
ISO"""


def marked(spark, *texts):
    return S.marked(S.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))


def test_document(spark):
    m = marked(spark, A)
    docs = spark.createDataFrame([(0, A)], "doc_id long, text string")
    assert [tuple(r)[1:] for r in S.titles(m).collect()] == [("Press Line SOP", 1)]
    assert tuple(S.first_match(docs, S.VERSION, "v").first()) == (0, "2.1.", 3, 3)
    assert tuple(S.first_match(docs, S.DATE, "d").first()) == (0, "3/14/2024", 4, 4)
    texts = {r.section: (r.text, r.s, r.e) for r in S.section_texts(m).collect()}
    assert texts["purpose"] == ("Keep the press safe.", 6, 7) and texts["scope"] == ("All sites.", 10, 10)
    assert [(r.ord, r.term, r.definition, r.line_no) for r in S.definitions(m).orderBy("ord").collect()] == [(1, "Emergency Shutdown (E-Stop)", "halts all", 12), (2, "Lockout/Tagout", "energy isolation", 14)]
    assert [(r.text, r.line_no) for r in S.responsibilities(m).orderBy("idx").collect()][:2] == [("Operator: check", 16), ("Lead: approve", 17)]
    assert [(r.text, r.s, r.e) for r in S.warnings(m).orderBy("idx").collect()] == [("Never reach in while running.", 18, 19), ("never reach in", 21, 21)]
    steps = [(r.step_number, r.title, r.body, r.n_substeps, r.s, r.e) for r in S.steps(m).orderBy("ord").collect()]
    assert steps == [("1", "Stop", "Press the button. Wait for it Lock Tag it.", 2, 24, 30), ("2", "Start", "", 0, 31, 31), ("5.1", "Odd", "inner inner two", 2, 32, 34), ("6.1.1", "orphan", "body", 0, 35, 36)]
    subs = [(r.step, r.text) for r in S.substeps(S.procedure_lines(m)).orderBy("step", "sub").collect()]
    assert subs == [(24, "Wait for it"), (24, "Lock Tag it."), (32, "inner"), (32, "inner two")]


def test_without_headings(spark):
    m = marked(spark, "1. One\nbody\n2) Two\n", "", "Only text.", "WARNING: a\n\nb")
    assert [(r.doc_id, r.step_number, r.body) for r in S.steps(m).orderBy("doc_id", "ord").collect()] == [(0, "1", "body"), (0, "2", "")]
    assert [(r.doc_id, r.text) for r in S.warnings(m).collect()] == [(3, "a")]
    assert S.section_texts(m).count() == 0


def test_natural_order(spark):
    df = spark.createDataFrame([("4.10",), ("4.9",), ("x",), ("10",), ("4.1a",), ("4.1",), ("2",)], "n string")
    assert [r.n for r in df.orderBy(S.step_key(F.col("n"))).collect()] == ["2", "4.1", "4.1a", "4.9", "4.10", "10", "x"]


def test_excerpts(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 2, 2), (1, 1, 3), (1, 0, 1), (1, 3, 2), (1, 2, 4)], "doc_id long, s int, e int")
    assert sorted(r.excerpt for r in S.excerpts(docs, spans, 1).collect()) == ["a\nb\nc", "a\nb\nc", "a\nb\nc"]
    assert sorted(r.excerpt for r in S.excerpts(docs, spans).collect()) == ["a\nb\nc", "b", "b\nc"]  # ends in the wrong order are exchanged


def test_cited_against_slices(spark):
    """Random spans, valid or not, repeated, null, in documents of any length, against slices of the line lists; other columns stay."""
    import random

    rng = random.Random(2)
    texts = ["\n".join(f"l{i} {rng.random()}" for i in range(n)) for n in (1, 2, 5, 40, 300)] + [""]
    docs = spark.createDataFrame([*enumerate(texts), (6, None)], "doc_id long, text string")
    rows = [(rng.randrange(8), i, rng.choice([None, *range(-1, 45)]), rng.choice([None, *range(-1, 45)])) for i in range(400)] + [(4, 400, 2, 299), (4, 401, 2, 299), (4, 402, 1, 301)]
    spans = spark.createDataFrame(rows, "doc_id long, cid long, s int, e int")
    for context in (0, 2):
        want = {}
        for d, cid, s, e in rows:
            lines = texts[d].split("\n") if d < len(texts) else []
            a, b = (min(s, e), max(s, e)) if s is not None and e is not None else (0, 0)
            want[cid] = "\n".join(lines[max(0, a - 1 - context) : b + context]) if 1 <= a and b <= len(lines) else None
        got = {r.cid: r.excerpt for r in S.cited(spans, docs, context).collect()}
        assert got == want


def test_capitals_inside_a_body(spark):
    """A line in capitals ends a section, the procedure's too; where the whole document is searched only known headings end a step."""
    m = marked(spark, "PROCEDURE:\nStep 1: Go\nbody\nLOTO\nmore", "Step 1: Go\nbody\nLOTO\nmore\nREFERENCES\nx")
    assert {r.doc_id: r.body for r in S.steps(m).collect()} == {0: "body", 1: "body LOTO more"}


def test_one_pass(spark):
    """All kinds at once equal the operators of one kind; null and empty texts have their row and no finding."""
    docs = spark.createDataFrame([(0, A), (1, None), (2, "")], "doc_id long, text string")
    m, rows = S.marked(S.lines(docs)), S.found(docs).orderBy("doc_id", "kind", "ord").collect()
    of = lambda kind, *c: [tuple(r[x] for x in c) for r in rows if r.kind == kind]
    assert of("step", "number", "title", "text", "n_substeps", "s", "e") == [(r.step_number, r.title, r.body, r.n_substeps, r.s, r.e) for r in S.steps(m).orderBy("ord").collect()]
    assert of("safety", "text", "s", "e") == [(r.text, r.s, r.e) for r in S.warnings(m).orderBy("idx").collect()]
    assert of("definition", "key", "text", "s") == [(r.term, r.definition, r.line_no) for r in S.definitions(m).orderBy("ord").collect()]
    assert of("responsibilities", "text", "s") == [(r.text, r.line_no) for r in S.responsibilities(m).orderBy("idx").collect()]
    assert of("substep", "of", "text") == [(24, "Wait for it"), (24, "Lock Tag it."), (32, "inner"), (32, "inner two")]
    assert of("version", "text", "s") == [("2.1.", 3)] and of("title", "text") == [("Press Line SOP",)]
    assert [r.doc_id for r in rows if r.kind == "document"] == [0, 1, 2] and {r.kind for r in rows if r.doc_id > 0} == {"document"}
