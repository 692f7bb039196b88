"""JSON texts as columns: one form for each value, how deep it goes, and values as text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Spark's own writer would put differently: other characters and escapes, numbers with a point or an exponent, minus zero, long numbers.
ODD = r"[^\x20-\x7E\n\r\t]|\\|\d[.eE]|-0|\d{17}"


def _canonical(texts: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            out = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            out.encode()
        except (ValueError, RecursionError):
            return None
        return out

    return texts.map(one)


def canonical(text: Column) -> Column:
    """The one form of a JSON text: keys in the order of code points at every depth, nothing between tokens, no escapes of letters; null if it is no JSON.

    Numbers keep their kind: 1.0 stays apart from 1, and floats are written as shortly as
    they can be read back. Of repeated keys the last one counts. Spark's own parser and
    writer do what they do alike; other texts, and those they refuse, go through Python.
    """
    own = F.to_json(F.try_parse_json(text))
    bare = lambda x: F.length(F.regexp_replace(x, r"\s", ""))
    same = ~text.rlike(ODD) & (bare(own) == bare(text))  # the parser takes text after the value and repeated keys for nothing
    plain = F.when(F.coalesce(same, F.lit(False)), own)
    return F.coalesce(plain, F.pandas_udf(_canonical, "string")(F.when(plain.isNull(), text)))


def depth(text: Column) -> Column:
    """Levels of objects and lists of a JSON text, 0 of a plain value; null of null."""
    outside = F.regexp_replace(F.replace(F.replace(text, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit("")), '"[^"]*"', "")
    marks = F.split(F.regexp_replace(outside, r"[^\[\]{}]", ""), "")
    step = lambda s, c: F.struct((at := s["at"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("at"), F.greatest(s["most"], at).alias("most"))
    return F.aggregate(marks, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step)["most"]


def quoted(text: Column) -> Column:
    """A string as a JSON token, null as null."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)
