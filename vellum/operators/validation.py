"""Checks of requests and of edited records: the first rule that is broken, or null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import strip

# Fixed values.
LEAST, MOST = 5, 20
FORMATS, VERSIONS = ("scorm", "html", "json"), ("1.2", "2004")
QUESTION = "struct<id:string,text:string,options:array<string>,correct_answer:int>"
RECORD = f"title string, learning_objectives array<string>, sections array<struct<id:string,content:string>>, passing_score int, questions array<{QUESTION}>"


def request_error(num_questions: Column, passing_score: Column, output_format: Column, version: Column) -> Column:
    """``num_questions`` and ``passing_score`` as strings."""
    n, p = F.try_to_number(strip(num_questions), F.lit("S9999999")), F.try_to_number(strip(passing_score), F.lit("S9999999"))
    return (
        F.when(n.isNull() | p.isNull(), "not integers").when(~n.between(LEAST, MOST), "questions out of range").when(~p.between(50, 100), "passing score out of range").when(~output_format.isin(*FORMATS), "output format").when(~version.isin(*VERSIONS), "version")
    )


def _blank(x: Column) -> Column:
    return x.isNull() | (strip(x) == "")


def module_error(r: Column) -> Column:
    """Of a record struct's module part (fields title, learning_objectives, sections)."""
    return (
        F.when(_blank(r["title"]), "title").when(F.coalesce(F.array_size(r["learning_objectives"]), F.lit(0)) == 0, "no objectives").when(F.exists(r["learning_objectives"], _blank), "blank objective")
        .when(F.coalesce(F.array_size(r["sections"]), F.lit(0)) == 0, "no sections").when(F.exists(r["sections"], lambda s: F.coalesce(s["id"], F.lit("")) == ""), "section without id").when(F.exists(r["sections"], lambda s: s["content"].isNull()), "section without content")
    )


def question_error(q: Column) -> Column:
    options = F.coalesce(F.array_size(q["options"]), F.lit(0))
    keys = F.transform(q["options"], lambda o: F.lower(strip(o)))
    return (
        F.when(q.isNull(), "question").when(F.coalesce(q["id"], F.lit("")) == "", "question without id").when(_blank(q["text"]), "question without text").when(~options.between(2, 4), "number of options").when(F.exists(q["options"], _blank), "blank option")
        .when(F.size(F.array_distinct(keys)) < options, "equal options").when(q["correct_answer"].isNull() | (q["correct_answer"] < 0) | (q["correct_answer"] >= options), "correct answer")
    )


def assessment_error(r: Column) -> Column:
    """Of a record struct's assessment part (fields passing_score, questions); the first question with a fault decides."""
    questions = r["questions"]
    each = F.transform(questions, lambda q, i: F.coalesce(F.when(F.array_position(F.transform(questions, lambda x: x["id"]), q["id"]) <= i, "id used twice"), question_error(q)))
    first = F.get(F.filter(each, lambda e: e.isNotNull()), F.lit(0))
    return F.when(r["passing_score"].isNull() | ~r["passing_score"].between(1, 100), "passing score").when(questions.isNull(), "no questions").when(F.array_size(questions) < LEAST, "too few questions").otherwise(first)
