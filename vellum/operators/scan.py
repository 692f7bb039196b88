"""Line scanner: text aimed at a machine reader, hidden characters, links and repetition.

Rules are data (`vellum.functions.rules`). A line is tested by one projection that makes
an array with an entry a kind; lines and rules are never multiplied into rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellum.functions import rules as R
from vellum.functions.guards import among, candidates, loose, required
from vellum.functions.text import collapse, strings, strip

Rule = tuple[str, bool, str]


def pattern(rule: Rule) -> str:
    return ("(?i)" if rule[1] else "") + rule[2]


def negated(line: Column, at: Column) -> Column:
    """Whether a negation ends right before the match that begins at ``at`` (from 1)."""
    start = F.greatest(F.lit(1), at - R.NEGATION_LOOKBACK)
    return F.substring(line, start, at - start).rlike("(?i)" + R.NEGATION)


def rule_hit(line: Column, rule: Rule) -> Column:
    """Whether the line meets the rule. Its lower case is first searched for what every match must hold."""
    hit = line.rlike(pattern(rule))
    if rule[0] == "instruction_override":  # only the first match of an override rule is looked at
        hit = hit & ~negated(line, F.regexp_instr(line, F.lit(pattern(rule))))
    needs = required(rule[2])
    if not needs:
        return hit
    low = F.lower(line)
    some = low.contains(needs[0])
    for n in needs[1:]:
        some = some | low.contains(n)
    return some & hit


#: Characters that a kind of hidden ones needs, or a long run of base64.
HIDDEN = "[" + R.ZERO_WIDTH + R.BIDI + R.INVISIBLE + R.CONFUSABLES + r"\xad\x1b\x{E0000}-\x{E007F}\x{FE00}-\x{FE0F}" + R.CONTROL[1:-1] + r"]|[A-Za-z0-9+/]{40}"


def marks(rules: Sequence[Rule]) -> list[str]:
    """The patterns of a mask: of each rule's candidates and, last, of hidden characters."""
    return [*(loose(r[2].replace(R.FOLLOWS, "")) for r in rules), HIDDEN]


def kinds_found(line: Column, mask: Column, rules: Sequence[Rule], hidden: bool) -> Column:
    """Kinds of rules and of hidden characters of a line, which is tested only for those that the mask of marks() leaves."""
    none = F.array().cast("array<string>")
    kinds = F.when(mask != 0, rule_kinds(line, rules, mask)).otherwise(none)
    return F.concat(kinds, F.when(among(mask, len(rules)), hidden_kinds(line)).otherwise(none)) if hidden else kinds


def rule_kinds(line: Column, rules: Sequence[Rule], mask: Column) -> Column:
    """The kinds of rules that the line meets, each once, in order."""
    by: dict[str, Column] = {}
    for i, r in enumerate(rules):
        hit = among(mask, i) & rule_hit(line, r)
        by[r[0]] = by[r[0]] | hit if r[0] in by else hit
    return F.filter(F.array(*[F.when(hit, F.lit(k)) for k, hit in by.items()]), lambda k: k.isNotNull())


def hidden_kinds(line: Column) -> Column:
    """Kinds of characters that a reader can't see or takes for others."""
    word = F.regexp_extract_all(line, F.lit(r"(\p{L}+)"), 1)
    invisible = line.rlike(R.TAG) | line.rlike(f"[{R.INVISIBLE}]") | line.rlike(R.SOFT_HYPHENS) | line.rlike(R.VARIATION)
    return F.filter(
        F.array(
            F.when(line.rlike(f"[{R.ZERO_WIDTH}]"), "zero_width"), F.when(invisible, "invisible_chars"), F.when(line.rlike(f"[{R.BIDI}]"), "bidi_override"), F.when(line.contains("\x1b"), "ansi_escape"),
            F.when(line.rlike(R.CONTROL), "control_char"), F.when(line.rlike(f"[{R.CONFUSABLES}]") & F.exists(word, lambda w: w.rlike(f"[{R.CONFUSABLES}]") & w.rlike("[A-Za-z]")), "homoglyph"), F.when(line.rlike(R.BASE64), "base64_blob"),
        ),
        lambda k: k.isNotNull(),
    )


def decoded_blob(line: Column) -> Column:
    """The text of the line's first long base64 run, null unless it is UTF-8, long enough and mostly printable."""
    blob = F.regexp_substr(line, F.lit(R.BASE64))
    bare = F.regexp_replace(blob, "=+$", "")
    padded = F.concat(bare, F.substring(F.lit("==="), F.lit(1), F.pmod(-F.length(bare), F.lit(4))))
    text = F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string"))
    text = F.when(F.pmod(F.length(bare), F.lit(4)) != 1, text)
    printable = F.length(F.regexp_replace(text, r"[^\P{C}\t\n\r]", ""))
    return F.when((F.length(strip(text)) >= R.BASE64_LEAST) & ~text.contains("�") & (printable >= R.BASE64_PRINTABLE * F.length(text)), text)


def _code(c: Column) -> Column:
    """The code point in hexadecimal, of four digits at least."""
    return F.regexp_replace(F.hex(F.encode(c, "UTF-32")), "^0{1,4}", "")


def visible(x: Column) -> Column:
    """Tabs as spaces, invisible and control characters as <U+XXXX>."""
    odd = "[" + R.ZERO_WIDTH + R.BIDI + R.INVISIBLE + r"\xad\x{E0000}-\x{E007F}\x{FE00}-\x{FE0F}\x00-\x08\x0a-\x1f\x7f-\x9f]"
    shown = F.array_join(F.transform(F.split(x, ""), lambda c: F.when(c.rlike(odd), F.format_string("<U+%s>", _code(c))).otherwise(c)), "")
    return F.replace(F.when(x.rlike(odd), shown).otherwise(x), F.lit("\t"), F.lit("    "))


def excerpt(x: Column, limit: int = R.EXCERPT) -> Column:
    t = visible(strip(x))
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, limit), r"\s+$", ""), F.lit("…")))


def tag_text(x: Column) -> Column:
    """The ASCII text that tag characters spell."""
    source = "".join(chr(0xE0000 + i) for i in range(0x20, 0x7F))
    return F.translate(F.regexp_replace(x, r"[^\x{E0020}-\x{E007E}]", ""), source, "".join(map(chr, range(0x20, 0x7F))))


def for_terminal(x: Column) -> Column:
    for p in (R.ANSI, R.CONTROL, "\r", f"[{R.ZERO_WIDTH}]", R.TAG, f"[{R.INVISIBLE}]", f"[{R.BIDI}]"):
        x = F.regexp_replace(x, p, "")
    return x


def findings(lines: DataFrame, rules: Sequence[Rule] = R.RULES, hidden: bool = True, blobs: bool = True) -> DataFrame:
    """(doc_id, line_no, kind, line): rule hits, hidden characters and hits inside decoded base64; a kind once a line, but for decoded ones."""
    line = F.col("line")
    some = lines.where("line <> ''").withColumn("_mask", candidates(line, marks(rules))).where("_mask <> 0")
    out = some.select("doc_id", "line_no", F.explode(kinds_found(line, F.col("_mask"), rules, hidden)).alias("kind"), "line")
    if not blobs:
        return out
    text = lines.where(line.rlike(R.BASE64)).select("doc_id", "line_no", decoded_blob(line).alias("line")).where("line is not null")
    every = F.filter(F.array(*[F.when(rule_hit(line, r), F.lit(r[0])) for r in rules]), lambda k: k.isNotNull())
    return out.unionByName(text.select("doc_id", "line_no", F.explode(every).alias("kind"), F.concat(F.lit("base64-decoded: "), "line").alias("line")))


def repetitions(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind, line, times): long lines that occur often in a document, at their first place."""
    key = collapse(F.col("line"))
    df = lines.select("doc_id", "line_no", key.alias("line")).where(F.length("line") >= R.REPEAT_CHARS)
    df = df.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("times"), F.min("line_no").alias("line_no")).where(F.col("times") >= R.REPEATS)
    return df.select("doc_id", "line_no", F.lit("repetition").alias("kind"), "line", "times")


def all_findings(lines: DataFrame, **how) -> DataFrame:
    """Findings with their severity and excerpt."""
    rep = repetitions(lines).select("doc_id", "line_no", "kind", F.concat(excerpt(F.col("line")), F.format_string(" (repeated %d times)", F.col("times"))).alias("excerpt"))
    hidden = F.when((F.col("kind") == "invisible_chars") & (tag_text(F.col("line")) != ""), F.concat(F.lit(' [hidden tag text: "'), excerpt(tag_text(F.col("line")), 60), F.lit('"]'))).otherwise("")
    out = findings(lines, **how).select("doc_id", "line_no", "kind", F.concat(excerpt(F.col("line")), hidden).alias("excerpt")).unionByName(rep)
    return out.withColumn("severity", F.when(F.array_contains(strings(list(R.HIGH_KINDS)), F.col("kind")), "high").otherwise("low"))


def risks(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, risk, findings, kinds, gates) for every document: high if any finding is, low if there is one, else none."""
    per = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("kind").alias("kinds"), F.max((F.col("severity") == "high").cast("int")).alias("high"))
    df = docs.select("doc_id").join(per.hint("merge"), "doc_id", "left")
    risk = F.when(F.col("high") == 1, "high").when(F.col("findings") > 0, "low").otherwise("none")
    return df.select("doc_id", risk.alias("risk"), F.coalesce("findings", F.lit(0)).cast("long").alias("findings"), F.coalesce("kinds", F.lit(0)).cast("long").alias("kinds"), (risk == "high").alias("gates"))


def restored_risk(stored: Column, count: Column) -> Column:
    """A stored verdict read back, failing closed: unknown or ``none`` with findings is high."""
    known = stored.isin("high", "low", "none")
    return F.when(~F.coalesce(known, F.lit(False)), F.when(count > 0, "high").otherwise("none")).when((stored == "none") & (count > 0), "high").otherwise(stored)


def pasted(df: DataFrame, column: str) -> DataFrame:
    """Adds ``lines``: a text's lines, a list's entries as they are, and none for null."""
    if df.schema[column].dataType.typeName() == "array":
        return df.withColumn("lines", F.coalesce(F.col(column).cast("array<string>"), F.array().cast("array<string>")))
    return df.withColumn("lines", F.coalesce(F.split(F.col(column).cast("string"), "\n"), F.array().cast("array<string>")))


def hidden_findings(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, kind) of characters that can't be seen or are taken for others."""
    return lines.where("line <> ''").select("doc_id", "line_no", F.explode(hidden_kinds(F.col("line"))).alias("kind"))


def counts_by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("findings"), F.countDistinct("doc_id").alias("docs"))


# Telephone patterns and words that speak of the writer's own situation.
PHONES = [r"\+\d[\d\s().-]{7,}\d", r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}", r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b", r"(?i)\b(?:phone|tel|telephone|call|contact|dial|text|whatsapp)\b[^.\n]{0,24}?\b\d{3}[-.\s]?\d{4}\b"]
META = ["instruction", "instructions", "prompt", "prompts", "assistant", "ai", "llm", "language model", "chatbot", "system message"]


def output_reasons(item: Column, source: Column, rules: Sequence[Rule] = R.RULES, hidden: bool = True) -> Column:
    """Why a generated item must not be used, in order and each once; empty if it may be."""
    # every line's candidates among the rules, hidden characters, telephone patterns and words on the writer
    said = "|".join(META) + "|\u0130"  # whose lower case begins with an i
    mask = candidates(item, [*marks(rules), *map(loose, PHONES), said])
    phone = F.lit(False)
    for i, p in enumerate(PHONES):
        phone = phone | among(mask, len(rules) + 1 + i) & item.rlike(p)
    meta = F.filter(F.array(*[F.when(F.lower(item).rlike(rf"\b{w}\b") & ~F.lower(F.coalesce(source, F.lit(""))).rlike(rf"\b{w}\b"), F.lit(w)) for w in sorted(META)]), lambda w: w.isNotNull())
    meta = F.when(among(mask, len(rules) + 1 + len(PHONES)), meta).otherwise(F.array().cast("array<string>"))
    kinds = kinds_found(item, mask, rules, hidden)
    more = F.array(F.when(phone, "phone_number"), F.when(item.rlike("[<>]"), "markup"), F.when(F.size(meta) > 0, F.concat(F.lit("meta_reference: "), F.array_join(meta, ", "))))
    found = F.array_distinct(F.filter(F.concat(F.array_sort(kinds), more), lambda r: r.isNotNull()))
    return F.when(strip(F.coalesce(item, F.lit(""))) == "", F.array(F.lit("empty"))).otherwise(found)


def first_of(df: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` findings of each document by line and kind; ties keep the excerpt's order."""
    return df.withColumn("n", F.row_number().over(W.partitionBy("doc_id").orderBy("line_no", "kind", "excerpt"))).where(F.col("n") <= n)
