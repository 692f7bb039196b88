"""Saved records back as typed columns: documents, modules, questions, assessments.

A record is JSON that a person or another version may have changed. Its fields are given by
a table: name, kind, default, and what null stands for. Nothing raises: a missing key
gives the default; a value of another kind counts as missing and its key is named in
``faults``; keys that the table doesn't know are kept in ``rest``. Parts without a fixed
shape (steps, sections, spans) stay canonical JSON texts. ``saved`` gives the record's JSON
again, so that what was saved whole comes back as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.functions.jsons import canonical, quoted

#: Kind of a field: its column's type, and the type under which its JSON is read.
KINDS = {"text": "string", "whole": "bigint", "flag": "boolean", "texts": "array<string>", "parts": "array<string>", "terms": "map<string,string>", "part": "string"}


@dataclass(frozen=True)
class Field:
    """default: as a JSON token; null: the token that null stands for, as it is by default."""

    name: str
    kind: str
    default: str
    null: str = "null"


def _lists(kind: str, *names: str) -> list[Field]:
    return [Field(n, kind, "[]", "[]") for n in names]


def _texts(*names: str) -> list[Field]:
    return [Field(n, "text", '""') for n in names]


# Fields of the saved form, in its order, with the defaults.
DOCUMENT = [
    *_texts("title", "version", "effective_date", "purpose", "scope"), *_lists("texts", "responsibilities"), *_lists("parts", "procedures"), *_lists("texts", "safety_warnings"), Field("definitions", "terms", "{}", "{}"), *_lists("texts", "references"),
    *_texts("raw_content"), Field("provenance", "part", "{}"), Field("lines", "texts", "[]"), Field("injection_scan", "part", "{}"),
]
MODULE = [*_texts("title"), *_lists("texts", "learning_objectives"), Field("objectives", "parts", "[]"), *_lists("parts", "sections"), Field("estimated_duration", "whole", "0"), *_lists("texts", "prerequisites"), *_texts("summary")]
QUESTION = [
    *_texts("id", "type", "text"), *_lists("texts", "options"), Field("correct_answer", "whole", "null"), *_texts("explanation"), Field("points", "whole", "1"), *_texts("salt"), Field("source_ref", "part", "{}", "{}"), *_texts("topic"),
]
ASSESSMENT = [
    *_texts("title", "description"), *_lists("parts", "questions"), Field("passing_score", "whole", "70"), Field("time_limit", "whole", "null"), Field("randomize_questions", "flag", "false"), Field("randomize_options", "flag", "true"),
    Field("requested_questions", "whole", "null"), *_lists("texts", "notes"), Field("leakage_count", "whole", "0", "0"),
]
#: Keys of the saved form that are worked out anew and never read.
COMPUTED = {"question": ("answer_hash",)}
RECORDS = {"document": DOCUMENT, "module": MODULE, "question": QUESTION, "assessment": ASSESSMENT}


def _fits(kind: str, is_: Column) -> Column:
    """Whether a value of a variant's type is of a field's kind; null is told apart before."""
    if kind in ("texts", "parts"):
        return is_.startswith("ARRAY<STRING>" if kind == "texts" else "ARRAY<OBJECT<") | (is_ == "ARRAY<VOID>")
    return is_.startswith("OBJECT<") if kind in ("terms", "part") else is_ == {"text": "STRING", "whole": "BIGINT", "flag": "BOOLEAN"}[kind]


def _token(kind: str, token: str) -> Column:
    """A default as a column."""
    if token == "null":
        return F.lit(None).cast(KINDS[kind])
    if kind == "terms":
        return F.expr("cast(map() as map<string,string>)")
    if kind in ("texts", "parts"):
        return F.array().cast("array<string>")
    return F.lit(token if kind == "part" else token[1:-1]) if kind in ("part", "text") else F.lit(token).cast(KINDS[kind])


def rebuilt(json: Column, record: str, only: list[str] | None = None) -> Column:
    """A struct of the record's fields, rest and faults, from canonical JSON (null or other JSON than an object: all defaults). With ``only``, of those fields alone."""
    fields = [f for f in RECORDS[record] if only is None or f.name in only]
    known = [*(f.name for f in fields), *COMPUTED.get(record, ())]

    def body(x: Column) -> Column:
        value, kinds = x["value"], x["kinds"]
        kind_of = lambda f: F.try_element_at(kinds, F.lit(f.name))
        wrong = [F.when(kind_of(f).isNotNull() & (kind_of(f) != "VOID") & ~_fits(f.kind, kind_of(f)), F.lit(f.name)) for f in fields]
        wrong.append(F.when(kind_of(Field("leakage_count", "whole", "0")) == "VOID", F.lit("leakage_count")) if record == "assessment" else F.lit(None).cast("string"))
        columns = []
        for f in fields:
            is_ = kind_of(f)
            default = _token(f.kind, f.default)
            if f.name == "requested_questions":
                default = F.coalesce(F.size(F.when(_fits("parts", F.try_element_at(kinds, F.lit("questions"))), value["questions"])), F.lit(0)).cast("bigint")
            columns.append(F.when(is_ == "VOID", _token(f.kind, f.null)).when(_fits(f.kind, is_), value[f.name]).otherwise(default).alias(f.name))
        if only is not None:
            return F.struct(*columns)
        rest = F.map_filter(F.coalesce(x["all"], F.expr("cast(map() as map<string,variant>)")), lambda k, _: ~k.isin(*known))
        readable = kinds.isNotNull()
        return F.struct(
            *columns, F.when(F.size(rest) > 0, F.to_json(rest)).alias("rest"),
            F.concat(F.when(~readable & x["text"].isNotNull() & (x["text"] != "null"), F.array(F.lit("not an object"))).otherwise(F.array().cast("array<string>")), F.filter(F.array(*wrong), lambda w: w.isNotNull())).alias("faults"),
        )

    whole = F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")
    if only is not None:
        whole = F.map_filter(whole, lambda k, _: k.isin(only))
    schema = ", ".join(f"`{f.name}` {KINDS[f.kind]}" for f in fields)
    parts = F.struct(json.alias("text"), F.from_json(json, schema).alias("value"), whole.alias("all"), F.transform_values(whole, lambda _, v: F.schema_of_variant(v)).alias("kinds"))
    return X.let(parts, body)


def saved(record: Column, kind: str) -> Column:
    """The JSON of a rebuilt struct, its fields in their order; what ``rest`` holds is not part of it."""

    def one(f: Field) -> Column:
        x = record[f.name]
        if f.kind == "text":
            return quoted(x)
        if f.kind in ("texts", "terms"):
            return F.to_json(x)
        if f.kind == "parts":
            return F.concat(F.lit("["), F.array_join(x, ","), F.lit("]"))
        return x if f.kind == "part" else x.cast("string")

    tokens = [F.concat(F.lit(f'"{f.name}":'), F.coalesce(one(f), F.lit("null"))) for f in RECORDS[kind]]
    if kind == "question":
        tokens.append(F.concat(F.lit('"answer_hash":'), quoted(answer_hash(record))))
    return F.concat(F.lit("{"), F.concat_ws(",", *tokens), F.lit("}"))


def answer_hash(question: Column) -> Column:
    """Of the question's own salt and the option that is correct now; empty without either."""
    right = F.when(question["correct_answer"] >= 0, F.get(question["options"], question["correct_answer"].cast("int")))
    made = X.answer_hash(question["salt"], right)
    return F.when((F.coalesce(question["salt"], F.lit("")) != "") & (F.coalesce(right, F.lit("")) != ""), made).otherwise(F.lit(""))


def _once(x: Column) -> Column:
    """The value, worked out once a row: the planner would write an expression out wherever it is used, but not across a generator."""
    return F.explode(F.array(x))


def rebuild(records: DataFrame, record: str, json_col: str = "json", keep: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """One row a record: the columns that ``keep`` names, the record's fields, rest, faults and ``saved``.

    In assessments, ``questions`` are rebuilt structs with answer_hash, rest and faults of
    their own. ``saved`` is canonical. Texts that are no JSON give all defaults and the
    fault "not an object"; null gives defaults. Columns of other names are not looked at.
    With ``only``, those fields are all that is made; its questions have options only.
    """
    keep = keep or []
    df = records.select(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)] or [F.lit(1).alias("k")]).alias("_keep"), F.col(json_col).alias("_text"), canonical(F.col(json_col)).alias("_json"))
    # text that is no JSON at all is told apart from null
    df = df.select("_keep", _once(rebuilt(F.when(F.col("_text").isNotNull(), F.coalesce("_json", F.lit('""'))), record, only)).alias("r"))
    columns = {f.name: F.col(f"r.{f.name}") for f in RECORDS[record] if only is None or f.name in only}
    kept = [F.col(f"_keep.k{i}").alias(c) for i, c in enumerate(keep)]
    if only is not None:
        if record == "assessment" and "questions" in only:
            columns["questions"] = F.transform("r.questions", lambda q: rebuilt(q, "question", ["options"]))
        return df.select(*kept, *[c.alias(n) for n, c in columns.items()])
    text = saved(F.col("r"), record)
    if record == "assessment":
        # each question with its hash and its JSON, made once
        of = lambda q: X.let(rebuilt(q, "question"), lambda s: F.struct(s.withField("answer_hash", answer_hash(s)).alias("question"), saved(s, "question").alias("saved")))
        df = df.withColumn("q", _once(F.transform("r.questions", of)))
        columns["questions"] = F.transform("q", lambda x: x["question"])
        text = saved(F.col("r").withField("questions", F.transform("q", lambda x: x["saved"])), record)
    if record == "question":
        columns["answer_hash"] = answer_hash(F.col("r"))
    out = df.select(*kept, *[c.alias(n) for n, c in columns.items()], F.col("r.rest").alias("rest"), F.col("r.faults").alias("faults"), _once(text).alias("_saved"))
    return out.withColumn("saved", canonical(F.col("_saved"))).drop("_saved")
