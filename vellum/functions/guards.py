"""What any match of a pattern must hold, so that a plain search can rule most texts out first: literals, or a looser pattern that takes linear time."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import cache
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: More alternatives than this, or shorter ones, don't pay.
MOST, SHORTEST = 40, 2


@cache
def required(pattern: str) -> tuple[str, ...]:
    """Lower-case strings one of which stands in the lower-case form of every text that matches; empty if none is known."""
    found = _of(_parser.parse(pattern, re.ASCII))
    return tuple(sorted(found)) if found and len(found) <= MOST and min(map(len, found)) >= SHORTEST else ()


def _of(parts) -> frozenset[str] | None:
    """The best set among those of a sequence's parts: long shortest member first, then few members."""
    sets: list[frozenset[str]] = []
    run = ""
    for op, arg in [*parts, (None, None)]:
        if op is C.LITERAL:
            run += chr(arg).lower()
            continue
        if run:
            sets.append(frozenset([run]))
            run = ""
        if op is C.SUBPATTERN:
            inner = _of(arg[-1])
        elif op is C.BRANCH:
            each = [_of(b) for b in arg[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            inner = _of(arg[2])
        else:
            inner = None
        if inner and len(inner) <= MOST:
            sets.append(inner)
    return max(sets, key=lambda s: (min(6, *map(len, s)) if len(s) > 1 else min(6, len(next(iter(s)))), -len(s)), default=None)


@cache
def loose(pattern: str) -> str:
    """A pattern of RE2 that finds something, letter case ignored, in every text in which Java finds ``pattern``; empty, which is found everywhere, if none is known.

    It has no word boundaries, no end and no bounds of runs, as these differ or cost most.
    """
    out, inside = "", False
    for token in re.findall(r"\\.|.", pattern.removesuffix("$"), re.S):
        if inside and token in "[&" or not inside and token in (r"\b", r"\B"):
            if inside:
                return ""
            continue
        inside = token == "[" or inside and token != "]"
        out += (r"\s\x0b" if inside else r"[\s\x0b]") if token == r"\s" else token  # Java's has the vertical tab
    out = re.sub(r"\{0,\d+\}\??", "*", out)
    try:
        pc.match_substring_regex(pa.array([""]), out, ignore_case=True)
    except pa.ArrowInvalid:
        return ""
    return out


#: Bits of a mask; of more patterns than that, some share one.
BITS = 63


def candidates(text: Column, patterns: Sequence[str]) -> Column:
    """A mask of the patterns, made loose already, that are found in the text: bit i for the i-th. A search for any of them rules most texts out."""
    counting = [p for p in patterns if re.search(r"\{\d\d", p)]  # long counts, which multiply the states of a search for all
    searches = ["|".join(f"(?:{p})" for p in patterns if p not in counting), *counting]

    def mask(texts: pa.Array) -> pa.Array:
        bits = np.zeros(len(texts), np.int64)
        hits = [pc.fill_null(pc.match_substring_regex(texts, p, ignore_case=True), False).to_numpy(zero_copy_only=False) for p in searches]
        at = np.flatnonzero(np.logical_or.reduce(hits))
        found = texts.take(pa.array(at))
        for i, p in enumerate(patterns):
            bits[at] |= pc.match_substring_regex(found, p, ignore_case=True).to_numpy(zero_copy_only=False).astype(np.int64) << i % BITS
        return pa.array(bits)

    return F.arrow_udf(mask, "long")(F.make_valid_utf8(text))


def among(mask: Column, i: int) -> Column:
    """Whether the i-th pattern is a candidate."""
    return mask.bitwiseAND(F.lit(1 << i % BITS).cast("long")) != 0
