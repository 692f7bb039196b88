"""Scalar text functions as columns. None needs Python, but for NFKC and similarity."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists and tables below are data that results depend on.
ELLIPSIS, OPTION_CHARS = "...", 180
FLIPS = [
    ("must not", "must"), ("shall not", "shall"), ("may not", "may"), ("do not", "you may"), ("does not", "does"), ("is not", "is"), ("never", "always"), ("always", "never"),
    ("must", "may optionally"), ("shall", "may optionally"), ("is required", "is optional"), ("are required", "are optional"), ("required", "optional"), ("prohibited", "permitted"),
    ("applies to all", "applies only to some"), ("all personnel", "only supervisors"), ("every", "any single"), ("prior to", "after"), ("before", "after"), ("at least", "at most"), ("all", "some"), ("may", "must never"),
]
STOPWORDS = """
a an and are as at be been before being between both but by can cannot could
did do does doing done during each either for from further had has have having
he her here hers him his how i if in into is it its itself just may me might
more most must my no nor not of off on once only or other our ours out over
own same she should so some such than that the their theirs them themselves
then there these they this those through to too under until up upon very was
we were what when where which while who whom why will with within would you
your yours
""".split()
POLARITY = """
after all always any before cannot every immediately least mandatory may most
must never no none not only optional permitted prohibited required shall some
without
""".split()
CONNECTIVES = ["then", "and", "also", "before", "after", "additionally", "furthermore", "plus", "next", "afterwards", "subsequently"]
STATEMENT_OPENERS = """
this these those that the a an it its there they he she we our
all any each every both either neither none no nothing anyone everyone someone
personnel operators operator employees staff technicians technician
supervisors supervisor engineers engineer inspectors inspector management
""".split()
IMPERATIVE_VERBS = """
confirm verify record review complete pull retrieve check inspect ensure make
document attach apply remove install seat loosen tighten torque bleed clean
wear don doff label print sign initial file scan measure weigh calibrate
adjust open close start stop shut isolate lock tag notify report escalate
contact obtain collect place position transfer move store dispose discard
rinse wipe flush purge sample test run execute perform follow repeat compare
calculate reconcile count enter log update submit approve reject segregate
quarantine hold release stage load unload mount align set select switch press
push pull turn rotate connect disconnect reconnect disable enable reset
restore energize wait allow observe monitor read write add mix dilute
sanitize sterilize decontaminate assemble disassemble reassemble replace
accession identify locate flag capture photograph annotate initiate activate
deactivate disengage engage engrave sort restart power secure authorize
never always do dont cross-reference spot-check double-check back-flush
""".split()
PREDICATES = """
is are was were will shall must should may can cannot has have had does
includes include means covers applies consists contains exists remains
provides requires ensures defines governs describes establishes
""".split()
DETERMINERS = "the a an this these those each all every any both either your its it them".split()
REGISTERS = ("statement", "imperative", "role")
CLAUSE_OPENERS = "if when once after before while during upon unless until whenever where using with for as in on at given following prior".split()

#: Runs of what is neither letter, digit, underscore nor per-cent sign in lower-case ASCII; named one by one, as Java looks those up in a table but tries ranges in turn.
MARKS = "[" + "".join(f"\\x{i:02x}" for i in range(128) if not (chr(i).isalnum() or chr(i) in "_%")) + "]+"


def strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space at both ends, line feeds and tabs included."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends; null as empty."""
    x = F.coalesce(x, F.lit(""))
    odd = x.contains("  ") | x.rlike("[^ -~]")  # most texts need no replacing
    return F.trim(F.when(odd, F.regexp_replace(x, r"(?U)\s+", " ")).otherwise(x))


def clip(x: Column, limit: int = OPTION_CHARS) -> Column:
    """At most ``limit`` characters with the ellipsis, cut at a word where one ends late enough."""
    budget = limit - len(ELLIPSIS)

    def cut(t: Column) -> Column:
        head = F.substring(t, 1, budget + 1)
        space = F.length(head) - F.locate(" ", F.reverse(head))  # 0-based place of the last space
        short = F.when((F.locate(" ", head) > 0) & (space > budget * 0.6), F.substring(head, F.lit(1), space)).otherwise(F.substring(t, 1, budget))
        return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(short, r"[ ,;:.\-]+$", ""), F.lit(ELLIPSIS)))

    return let(collapse(x), cut)


def truncate(x: Column, most: int) -> Column:
    """At most ``most`` characters, cut at a word, without an ellipsis."""
    t = strip(F.coalesce(x, F.lit("")))
    head = F.substring(t, 1, most)
    words = F.regexp_replace(head, r" [^ ]*$", "")
    return F.when(F.length(t) <= most, t).otherwise(F.when(F.length(words) > 0, words).otherwise(head))


def sentences(x: Column, least: int = 20) -> Column:
    """The sentences of at least ``least`` characters."""
    return F.filter(F.transform(F.split(collapse(x), r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= max(least, 1))


def alterable(x: Column) -> Column:
    """Whether the text holds a word of a flip; the others have no variant."""
    return x.rlike(rf"(?i)\b(?:{'|'.join(dict.fromkeys(max(old.split(), key=len) for old, _ in FLIPS))})\b")


def altered(x: Column) -> Column:
    """A false variant by the first flip that fits, at its first place; null if none does."""

    def flip(t: Column, low: Column, old: str, new: str) -> Column:
        def swap(at: Column) -> Column:
            upper = F.substring(t, at, F.lit(1)).rlike("^[A-Z]")
            word = F.when(upper, F.lit(new[:1].upper() + new[1:])).otherwise(F.lit(new))
            return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), word, F.substring(t, at + len(old), F.length(t))))

        return F.when(low.contains(old), let(F.regexp_instr(t, F.lit(rf"(?i)\b{old}\b")), swap))

    return F.when(alterable(x), let(collapse(x), lambda t: let(F.lower(t), lambda low: F.coalesce(*[flip(t, low, *f) for f in FLIPS]))))


def words(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"([A-Za-z][A-Za-z'\-]*)"), 1)


def register(x: Column) -> Column:
    """The opening form of a sentence, one of REGISTERS."""
    has = lambda names, w: F.array_contains(strings(names), w)

    def form(t: Column, tokens: Column) -> Column:
        adverb = lambda s, w: s["on"] & F.lower(w).endswith("ly")
        # leading adverbs fall away while something follows them
        start = F.aggregate(tokens, F.struct(F.lit(0).alias("i"), F.lit(True).alias("on")), lambda s, w: F.struct((s["i"] + F.when(adverb(s, w), 1).otherwise(0)).alias("i"), adverb(s, w).alias("on")))["i"]
        return let(F.least(start, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda at: judged(t, tokens, F.lower(F.get(tokens, at)), F.lower(F.coalesce(F.get(tokens, at + 1), F.lit("")))))

    def judged(t: Column, tokens: Column, first: Column, second: Column) -> Column:
        return (
            F.when(t.rlike(r"^[A-Z][\w/&.\-]*(?:\s+[A-Za-z][\w/&.\-]*){0,4}:\s+\S"), "role")
            .when(F.size(tokens) == 0, "statement")
            .when(has(STATEMENT_OPENERS, first), "statement")
            .when(has(IMPERATIVE_VERBS, first), "imperative")
            .when(has(PREDICATES, second), "statement")
            .when(has(DETERMINERS, second), "imperative")
            .otherwise("statement")
        )

    def opened(t: Column, own: Column) -> Column:
        opens = has(CLAUSE_OPENERS, F.lower(F.get(own, F.lit(0)))) & t.contains(",")
        tokens = F.when(opens, words(F.substring(t, F.locate(",", t) + 1, F.length(t)))).otherwise(own)
        return let(tokens, lambda k: form(t, k))

    return let(collapse(x), lambda t: let(words(t), lambda own: opened(t, own)))


def _udf(f: Callable, kind: str, *x: Column) -> Column:
    """f over batches of values; made when it is called, as it needs a session."""

    def one(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else f(v) for v in s], dtype="object")

    def two(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or w is None else f(v, w) for v, w in zip(s, t, strict=True)], dtype="object")

    return F.pandas_udf(one if len(x) == 1 else two, kind)(*x)


def nfkc(x: Column) -> Column:
    return _udf(lambda s: unicodedata.normalize("NFKC", s), "string", x)


def nfkc_folded(x: Column) -> Column:
    return _udf(lambda s: unicodedata.normalize("NFKC", s).casefold(), "string", x)


def similarity(a: Column, b: Column) -> Column:
    """Twice the matched characters over all, by longest common blocks; not a distance that SQL has."""
    return _udf(lambda s, t: SequenceMatcher(None, s, t).ratio(), "double", a, b)


def option_key(x: Column, unicode: bool = False) -> Column:
    """Lower-case letters and digits, runs of others as one space. With ``unicode``, compatibility forms are unified first, in Python, where they can occur."""
    t = F.coalesce(x, F.lit(""))
    if unicode:
        t = F.when(t.rlike(r"[^\x00-\x7f]"), nfkc(t)).otherwise(t)
    return F.trim(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", " "))


def normalized(x: Column, unicode: bool = False) -> Column:
    """For grounding: folded, punctuation but the per-cent sign as spaces."""
    t = F.coalesce(x, F.lit(""))
    plain = F.octet_length(t) == F.length(t)  # most texts are, and need no Unicode classes
    full = F.when(plain, F.lower(t)).otherwise(nfkc_folded(t)) if unicode else F.lower(t)
    return F.trim(F.when(plain, F.regexp_replace(F.lower(t), MARKS, " ")).otherwise(F.regexp_replace(full, r"(?U)[^\w%]+", " ")))


def tokens(x: Column, unicode: bool = False) -> Column:
    return F.array_remove(F.split(normalized(x, unicode), " "), "")


def content_words(x: Column, unicode: bool = False) -> Column:
    return F.filter(F.split(normalized(x, unicode), " "), lambda w: ~w.isin("", *STOPWORDS))  # a set, where an array would be read through for every word


def numbers(x: Column) -> Column:
    """Distinct numbers without thousands separators."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(\d+(?:[.,]\d+)*)"), 1), lambda n: F.replace(n, F.lit(","), F.lit(""))))


def named_terms(x: Column) -> Column:
    """Capitalised words but the first, normalised, without stop words, sorted."""
    found = F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"([A-Za-z][\w/\-]*)"), 1)
    rest = F.filter(F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(1))), lambda w: w.rlike("^[A-Z]"))
    return F.sort_array(F.array_distinct(F.flatten(F.transform(rest, lambda w: content_words(w)))))


def polarity(x: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(F.split(normalized(x), " "), lambda w: w.isin(*POLARITY))))


def added_words(x: Column, known: Column) -> Column:
    """Words of clauses that a connective opens and of which nothing is among ``known``, in order, each once.

    The fold keeps the run that is open (null outside one) and the words found so far.
    """
    none, empty = F.lit(None).cast("array<string>"), F.array().cast("array<string>")
    lost = lambda run: (F.size(run) > 0) & ~F.arrays_overlap(run, known)

    def close(s: Column, run: Column) -> Column:
        return F.struct(run.alias("run"), F.when(s["run"].isNotNull() & lost(s["run"]), F.concat(s["found"], s["run"])).otherwise(s["found"]).alias("found"))

    def step(s: Column, w: Column) -> Column:
        opens = w.isin(*CONNECTIVES)
        grown = F.when(s["run"].isNotNull() & ~w.isin(*STOPWORDS), F.concat(s["run"], F.array(w))).otherwise(s["run"])
        return F.when(w == "\x01", close(s, none)).when(opens, close(s, empty)).otherwise(F.struct(grown.alias("run"), s["found"].alias("found")))

    clauses = F.split(F.coalesce(x, F.lit("")), r"[;:,.!?()\[\]–—]|\s-\s")
    stream = F.flatten(F.transform(clauses, lambda c: F.concat(tokens(c), F.array(F.lit("\x01")))))
    found = F.array_distinct(F.aggregate(stream, F.struct(none.alias("run"), empty.alias("found")), step, lambda s: s["found"]))
    return F.when(F.lower(x).rlike("|".join(CONNECTIVES)), found).otherwise(empty)  # no clause opens without one


def escaped(x: Column) -> Column:
    """For HTML."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def listed(x: Column) -> Column:
    """An array as "A, B and C"."""
    n = F.size(x)
    return F.when(n <= 1, F.array_join(x, "")).otherwise(F.concat(F.array_join(F.slice(x, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(x, -1)))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(x)), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def document_key(title: Column, version: Column) -> Column:
    return F.sha2(F.concat_ws("|", strip(F.coalesce(title, F.lit(""))), strip(F.coalesce(version, F.lit("")))), 256)


def question_digest(key: Column, question: Column) -> Column:
    return F.sha2(F.concat_ws("|", key, question), 256)


def salt(key: Column, question: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("|", key, question, F.lit("salt")), 256), F.lit(32))


def answer_hash(salt_: Column, option: Column) -> Column:
    return F.sha2(F.concat_ws("|", salt_, option_key(option)), 256)


def numbered(line_no: Column, line: Column) -> Column:
    return F.concat(F.lit("L"), F.lpad(line_no.cast("string"), 4, "0"), F.lit(": "), line)


def scaled_points(points: Column, options: Column) -> Column:
    return F.when(options <= 2, F.greatest(F.lit(1), F.floor(points / 2).cast("int"))).otherwise(points)


def timespan(seconds: Column) -> Column:
    """Seconds as HHHH:MM:SS.CC, at most 9999:59:59.99; negative or missing ones as none."""
    cs = F.least(F.coalesce(F.greatest(F.floor(seconds * 100), F.lit(0)), F.lit(0)).cast("long"), F.lit(3599999999))
    part = lambda of, per: F.floor(F.pmod(cs, F.lit(of)) / per).cast("long")
    return F.format_string("%04d:%02d:%02d.%02d", F.floor(cs / 360000).cast("long"), part(360000, 6000), part(6000, 100), F.pmod(cs, F.lit(100)))


def duration(seconds: Column) -> Column:
    """Seconds as PT#H#M#.##S, all three parts always there."""
    cs = F.coalesce(F.greatest(F.floor(seconds * 100), F.lit(0)), F.lit(0)).cast("long")
    return F.format_string("PT%dH%dM%.2fS", F.floor(cs / 360000).cast("long"), F.floor(F.pmod(cs, F.lit(360000)) / 6000).cast("long"), F.pmod(cs, F.lit(6000)) / 100.0)
