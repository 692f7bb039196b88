"""Questions for a document: what it can support, a selection that covers it, and options that give nothing away.

Everything about single texts (clipping, keys, false variants, opening forms) is worked
out by SQL expressions in `facts`. Only what has to look at a document's questions
together, one after the other, is Python: choosing wrong options, the selection and its
repairs. It runs on one document's facts at a time, in batches, without a shuffle.

Where an order is arbitrary it is that of SHA-256 digests, so results don't depend on
the machine or on the rows' order.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from functools import cached_property, lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import quiz as Z
from vellum.operators import structure as S
from vellum.sources.shared import stored

# Points, limits and the order in which categories are filled.
CHOICE, TWO_WAY, SAFETY_CHOICE, SAFETY_TWO_WAY = 2, 1, 4, 2
NEAR, LEAST_QUESTIONS, SWAPS = 0.88, 5, 12
CYCLE = ("step", "purpose_scope", "safety", "step", "definition", "sequence", "step")
ENDING = "No further action - the procedure ends here."
# Wording of the questions.
TRUE_OR_FALSE = "True or False: "
ASK = {
    "purpose": "What is the primary purpose of this procedure, as stated in the SOP?",
    "scope": "According to the SOP, where and to whom does this procedure apply?",
    "definition": 'As defined in this SOP, what does "{term}" mean?',
    "step": 'According to Step {number} ("{title}"), what must be done?',
    "bare_step": "What action does Step {number} of this procedure require?",
    "sequence": 'Which action is performed immediately after Step {number} ("{title}")?',
    "safety": "Which of the following safety warnings is stated in this SOP?",
    "contradiction": "Which of the following statements CONTRADICTS a safety warning in this SOP?",
}
SAY = {
    "purpose": "the SOP states this purpose",
    "scope": "this procedure applies as follows",
    "definition": 'in this SOP, "{term}" is defined as - ',
    "safety": "this SOP requires the following - ",
}
REQUIRED = [
    ("md_req_1", 4, "What should you do if you cannot follow this procedure as written?", "Stop work and notify your supervisor or QA so the deviation can be approved and documented before you continue",
     ["Complete the work using your best judgement and record what you did in the batch record afterwards", "Follow the version of the procedure you were originally trained on, since that one is known to work", "Ask an experienced colleague how they normally handle it and follow the approach they describe"]),
    ("md_req_2", 2, "Deviations from this procedure could potentially impact product quality or patient safety.", None, []),
]


def material(x: Column) -> Column:
    """All that is needed of one text: itself, clipped, its key and opening form, and the same of its false variant."""

    def own(t: Column, alt: Column) -> Column:
        key = lambda c: T.option_key(c)
        return T.let(F.struct(T.clip(t).alias("a"), F.when(alt.isNotNull(), T.clip(alt)).alias("b")), lambda c: F.struct(t.alias("text"), c["a"].alias("clip"), key(c["a"]).alias("key"), T.register(t).alias("form"), alt.alias("alt"), c["b"].alias("alt_clip"), key(c["b"]).alias("alt_key"), T.register(alt).alias("alt_form")))

    return T.let(T.collapse(x), lambda t: T.let(T.altered(t), lambda alt: own(t, alt)))


def facts(docs: DataFrame) -> DataFrame:
    """One row a document, in one pass and one exchange: doc_key and arrays of materials: purpose, scope, responsibilities, definitions (with term), steps (with number, in natural order), warnings."""
    f = S.found(docs.select("doc_id", "text"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    listed = lambda kind, *cols: F.sort_array(F.collect_list(of(kind, F.struct(*cols))))
    df = f.groupBy("doc_id").agg(
        *[F.max(of(k, F.col("text"))).alias(k) for k in ("title", "version")], *[T.sentences(F.max(of(k, F.col("text")))).alias(f"_{k}") for k in ("purpose", "scope")],
        listed("responsibilities", "ord", "text").alias("_resp"), listed("definition", "ord", F.col("key").alias("term"), F.col("text").alias("definition")).alias("_defs"),
        listed("step", S.step_key(F.col("number")).alias("k"), "ord", F.col("number").alias("step_number"), "title", F.col("text").alias("body"), "s", "e").alias("_steps"), listed("safety", "ord", "text").alias("_warn"),
    )
    each = lambda c, f: F.coalesce(F.transform(c, f), F.array())
    return df.select(
        "doc_id", T.document_key(F.col("title"), F.col("version")).alias("doc_key"), each("_purpose", material).alias("purpose"), each("_scope", material).alias("scope"), each("_resp", lambda r: material(r["text"])).alias("responsibilities"),
        each("_defs", lambda d: F.struct(d["term"].alias("term"), material(d["definition"]).alias("m"))).alias("definitions"),
        each("_steps", lambda s: F.struct(s["step_number"].alias("number"), s["title"].alias("title"), s["s"].alias("s"), s["e"].alias("e"), (s["body"] != "").alias("has_body"), material(F.when(s["body"] != "", s["body"]).otherwise(s["title"])).alias("m"), material(F.when(s["title"] != "", s["title"]).otherwise(s["body"])).alias("t"))).alias("steps"),
        each("_warn", lambda w: material(w["text"])).alias("warnings"),
    )


@dataclass
class Text:
    text: str
    clip: str
    key: str
    form: str
    alt: str | None = None
    alt_clip: str | None = None
    alt_key: str | None = None
    alt_form: str | None = None

    @cached_property
    def false(self) -> Text | None:
        return Text(self.alt, self.alt_clip, self.alt_key, self.alt_form) if self.alt else None

    @cached_property
    def related(self) -> set[str]:
        """A statement and its negation are one material."""
        return {k for k in (self.key, self.alt_key if self.alt else None) if k}


@dataclass
class Item:
    category: str
    order: int
    id: str
    points: int
    prompt: str
    correct: Text
    sources: list[Text] = field(default_factory=list)
    wrong: list[Text] = field(default_factory=list)
    least: int = 1
    two_way: bool = False
    false_prompt: str | None = None
    false_material: Text | None = None
    ref: dict = field(default_factory=dict)
    kind: str = "multiple_choice"

    @cached_property
    def answers(self) -> set[str]:
        return self.correct.related | (self.false_material.related if self.false_material else set())

    @property
    def worth(self) -> int:
        return self.points if self.two_way or len(self.wrong) > 1 else max(1, self.points // 2)

    @cached_property
    def usable(self) -> list[Text]:
        """The sources that neither hold the right option nor are held by it."""
        return [s for s in self.sources if s.key not in self.correct.key and self.correct.key not in s.key]

    def extreme(self, longest: bool) -> bool:
        lengths = [len(w.clip) for w in self.wrong]
        own = len(self.correct.clip)
        return not self.two_way and bool(lengths) and (own >= max(lengths) if longest else own <= min(lengths))


def digest(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()


def alike(a: str, b: str) -> bool:
    """Whether two texts are near; most aren't by the bounds that lengths and common letters set."""
    return 2 * min(len(a), len(b)) >= (NEAR - 1e-9) * (len(a) + len(b)) and _alike(a, b)


@lru_cache(1 << 15)
def _alike(a: str, b: str) -> bool:
    """For texts of like lengths. Documents of one house share many texts, so a task keeps what it compared last."""
    if 2 * (Counter(a) & Counter(b)).total() < (NEAR - 1e-9) * (len(a) + len(b)):
        return False
    return SequenceMatcher(None, a, b).ratio() >= NEAR


def wrong_options(correct: Text, sources: list[Text], seed: str, most: int = 3) -> list[Text]:
    """Up to ``most`` of the sources that differ from the correct text, by turns the nearest longer and the nearest shorter one."""
    pool: dict[str, Text] = {}
    for s in sources:
        if s.key and s.key not in pool and s.key != correct.key and s.key not in correct.key and correct.key not in s.key and not alike(s.key, correct.key):
            pool[s.key] = s
    n = len(correct.clip)
    gaps = Counter(abs(len(s.clip) - n) for s in pool.values())  # only equal ones need a digest
    ranked = sorted(pool.values(), key=lambda s: (gap := abs(len(s.clip) - n), digest(seed, s.key) if gaps[gap] > 1 else ""))
    sides = [[s for s in ranked if len(s.clip) > n], [s for s in ranked if len(s.clip) <= n]]
    out: list[Text] = []
    while len(out) < most and any(sides):
        side = sides[len(out) % 2] or sides[1 - len(out) % 2]
        out.append(side.pop(0))
    return out


def like(form: str, texts: list[Text], enough: int | None = None) -> list[Text]:
    """Those of one opening form; where ``enough`` is given and not met, the others after them."""
    same = [t for t in texts if t.form == form]
    return same if enough is None or len(same) >= enough else same + [t for t in texts if t.form != form]


def turns(a: list[Item], b: list[Item], rotate: int = 0) -> list[Item]:
    b = b[rotate % len(b) :] + b[: rotate % len(b)] if b else b
    return [x for pair in zip(a, b) for x in pair] + a[len(b) :] + b[len(a) :]  # noqa: B905


def supported(doc: dict) -> list[Item]:
    """Every question that the document can support, in a stable order."""
    key = doc["doc_key"]
    purpose, scope = ([Text(**m) for m in doc[k]] for k in ("purpose", "scope"))
    people = [t for t in (Text(**m) for m in doc["responsibilities"]) if len(t.text) >= 15]
    terms = [(d["term"], Text(**d["m"])) for d in doc["definitions"] if len(d["m"]["text"]) >= 10]
    meanings = [t for _, t in terms if len(t.text) >= 15]
    steps = [(s["number"], s["title"], Text(**s["m"]), Text(**s["t"]), s["s"], s["e"], s["has_body"]) for s in doc["steps"]]
    out: list[Item] = []

    def choice(*args, most: int = 3, **more) -> Item | None:
        item = Item(*args, **more)
        item.wrong = wrong_options(item.correct, item.sources, digest(key, item.id), most)
        return item if len(item.wrong) >= item.least else None

    mc, tf = [], []
    for i, (name, own, other, ask, say) in enumerate([("purpose", purpose, scope, ASK["purpose"], SAY["purpose"]), ("scope", scope, purpose, ASK["scope"], SAY["scope"])]):
        if own:
            false = [t.false for t in own + other if t.alt]
            mc.append(choice("purpose_scope", i, f"{name}_mc_1", CHOICE, ask, own[0], like(own[0].form, other + people + meanings + false), least=2, ref={"kind": name}))
            tf.append(Item("purpose_scope", 3 - i, f"{name}_tf_1", TWO_WAY, f"{TRUE_OR_FALSE}{say} - {own[0].clip}", own[0], two_way=True, false_prompt=own[0].alt and f"{TRUE_OR_FALSE}{say} - {own[0].alt_clip}", false_material=own[0].false, ref={"kind": name}))
    out += turns([m for m in mc if m], sorted(tf, key=lambda t: t.order))

    mc, tf = [], []
    for i, (term, meaning) in enumerate(terms):
        others = [m for t, m in terms if t != term]
        mc.append(choice("definition", i, f"def_mc_{i + 1}", CHOICE, ASK["definition"].format(term=term), meaning, like(meaning.form, others + purpose + scope + [s[2] for s in steps], 3), ref={"kind": "definition", "term": term}))
        if others:
            wrong = min(others, key=lambda m: digest(key, f"def_tf_{i + 1}", m.text))
            say = TRUE_OR_FALSE + SAY["definition"].format(term=term)
            tf.append(Item("definition", i, f"def_tf_{i + 1}", TWO_WAY, say + meaning.clip, meaning, two_way=True, false_prompt=say + wrong.clip, false_material=wrong, ref={"kind": "definition", "term": term}))
    out += turns([m for m in mc if m], tf, 1)

    places = [i for n, _, i in Z.bisection(len(steps)) if n == len(steps)]
    if len(steps) >= 2:
        for order, i in enumerate(places):
            number, title, text, _, s, e, body = steps[i]
            ask = ASK["step" if body else "bare_step"].format(number=number, title=title)
            others = [x[2] if body else x[3] for j, x in enumerate(steps) if j != i]
            out.append(choice("step", order, f"step_mc_{_name(number)}", CHOICE, ask, text, like(text.form, others + meanings + scope, 3), ref={"kind": "step", "step_number": number, "s": s, "e": e}))
    if len(steps) >= 3:
        for order, i in enumerate(p for p in places if p < len(steps) - 1):
            number, title, after = steps[i][0], steps[i][1], steps[i + 1]
            item = choice("sequence", order, f"seq_{_name(number)}", CHOICE, ASK["sequence"].format(number=number, title=title), after[3], [x[3] for j, x in enumerate(steps) if j not in (i, i + 1)], ref={"kind": "sequence", "step_number": after[0]}, kind="sequence")
            if item and len(item.wrong) < 2:
                end = Text(ENDING, ENDING, "no further action the procedure ends here", "statement")
                item.wrong.append(end)
                item.sources.append(end)
            out.append(item)

    warnings = list({t.key: t for t in reversed([Text(**m) for m in doc["warnings"]]) if len(t.text) >= 15}.values())[::-1]
    mc, tf = [], []
    for i, w in enumerate(warnings):
        ref = {"kind": "safety", "warning_index": i}
        false = [v.false for j, v in enumerate(warnings) if j != i and v.alt]
        mc.append(choice("safety", 2 * i, f"safety_mc_{i + 1}", SAFETY_CHOICE, ASK["safety"], w, false, ref=ref))
        say = TRUE_OR_FALSE + SAY["safety"]
        tf.append(Item("safety", 2 * i + 1, f"safety_tf_{i + 1}", SAFETY_TWO_WAY, say + w.clip, w, two_way=True, false_prompt=w.alt and say + w.alt_clip, false_material=w.false, ref=ref))
        if len(warnings) >= 3 and i < 2 and w.alt:
            mc.append(choice("safety", 100 + i, f"safety_neg_{i + 1}", SAFETY_CHOICE, ASK["contradiction"], w.false, [v for j, v in enumerate(warnings) if j != i], least=2, ref={"kind": "safety_contradiction", "warning_index": i}))
    out += turns(sorted([m for m in mc if m], key=lambda m: m.order), tf, 1)
    return [x for x in out if x]


def _name(number: str) -> str:
    return "_".join(filter(None, "".join(c if c.isascii() and c.isalnum() else " " for c in number).split(" ")))


@lru_cache(1024)
def flat(s: str) -> Text:
    return Text(s, s, " ".join("".join(c if c.isalnum() else " " for c in s.lower()).split()), "statement")


def required() -> list[Item]:
    return [Item("md_required", i, qid, points, ask, flat(right or ask), [], [flat(w) for w in wrong], 3 if wrong else 0, two_way=right is None, ref={"kind": "md_required"}) for i, (qid, points, ask, right, wrong) in enumerate(REQUIRED)]


def blocked(item: Item, others: list[Item]) -> set[str]:
    return set().union(*[o.answers for o in others if o is not item])


def repairable(item: Item, others: list[Item]) -> bool:
    """Whether enough wrong options remain once the other questions' answers are taken out."""
    if item.two_way or item.category == "md_required":
        return True
    bad = blocked(item, others)
    left: set[str] = set()
    for s in item.usable:
        if len(left) >= item.least:
            break
        if s.related.isdisjoint(bad):
            left.add(s.key)
    return len(left) >= item.least


def select(pool: list[Item], count: int) -> list[Item]:
    """Required questions, one of safety, one of sequence, then the cycle; no text answers two questions."""
    queues: dict[str, list[Item]] = {}
    for x in pool:
        queues.setdefault(x.category, []).append(x)
    chosen: list[Item] = []

    def take(category: str) -> bool:
        queue = queues.get(category, [])
        while queue and len(chosen) < count:
            x = queue.pop(0)
            if x.answers.isdisjoint(blocked(x, chosen)) and repairable(x, chosen) and all(repairable(c, [*chosen, x]) for c in chosen):
                chosen.append(x)
                return True
        return False

    while take("md_required"):
        pass
    take("safety")
    take("sequence")
    turn = 0
    while len(chosen) < count and any(queues.values()):
        take(CYCLE[turn % len(CYCLE)])
        turn += 1
        if turn % len(CYCLE) == 0 and not any(queues.get(c) for c in CYCLE):
            break
    return chosen


def rebalance(chosen: list[Item], pool: list[Item]) -> None:
    """Swaps questions whose right option is the longest (then the shortest) for others of their category while those hold too many points."""
    for longest in (True, False):
        for _ in range(SWAPS):
            told = sum(x.worth / 2 if x.two_way else x.worth * x.extreme(longest) for x in chosen)
            if told <= Z.LENGTH_CEILING * sum(x.worth for x in chosen):
                break
            spare = [p for p in pool if not p.two_way and p.id not in {c.id for c in chosen}]
            swap = next(
                ((i, p) for strict in (True, False) for i in sorted((i for i, x in enumerate(chosen) if x.extreme(longest)), key=lambda i: (-chosen[i].worth, chosen[i].id)) for p in spare
                 if p.category == chosen[i].category and not p.extreme(longest) and not (strict and p.extreme(not longest)) and (rest := chosen[:i] + chosen[i + 1 :]) is not None
                 and not p.answers & blocked(p, rest) and repairable(p, rest) and all(repairable(c, [*rest, p]) for c in rest)), None,
            )
            if swap is None:
                break
            chosen[swap[0]] = swap[1]


def repair(chosen: list[Item], key: str) -> int:
    """Takes other questions' answers out of the wrong options; how many could not be."""
    left = 0
    for x in chosen:
        bad = blocked(x, chosen)
        leaking = [w for w in x.wrong if w.related & bad]
        if x.two_way or not leaking:
            continue
        new = wrong_options(x.correct, [s for s in x.sources if not s.related & bad], digest(key, x.id), len(x.wrong))
        if len(new) >= x.least:
            x.wrong = new
        else:
            left += len(leaking)
    return left


def assess(doc: dict, count: int, medical: bool, known: list[Item] | None = None, texts: bool = True) -> list[dict]:
    """The rows of a document's questions, with the right option first; ``known``: what the document supports, where that is worked out already. Without ``texts``, what SIZES holds: of options their lengths."""
    own = supported(doc) if known is None else known
    key, pool = doc["doc_key"], (required() if medical else []) + own
    before = [x.wrong for x in own]
    try:
        return _assessed(key, pool, count, texts)
    finally:
        for x, wrong in zip(own, before, strict=True):  # a repair gives an item another list
            x.wrong = wrong


def _assessed(key: str, pool: list[Item], count: int, texts: bool) -> list[dict]:
    chosen, leaks = select(pool, max(count, LEAST_QUESTIONS)), 0
    for _ in range(2):
        rebalance(chosen, pool)
        leaks = repair(chosen, key)
    chosen.sort(key=lambda x: (Z.RANK[x.category], x.order, x.id))
    fixed, free, out = sum(x.two_way and not x.false_prompt for x in chosen), 0, []
    for i, x in enumerate(chosen):
        true = True
        if x.two_way and x.false_prompt:
            free += 1
            true = not (free <= fixed + 1 or (free - fixed - 1) % 2 == 0)
        options = ["True", "False"] if x.two_way else [x.correct.clip, *[w.clip for w in sorted(x.wrong, key=lambda w: digest(key, x.id, w.key))]]
        if not texts:
            out.append({"ord": i + 1, "id": x.id, "type": "true_false" if x.two_way else x.kind, "options": [len(o) for o in options], "correct_answer": 0 if true else 1, "points": x.worth})
            continue
        salt = digest(key, x.id, "salt")[:32]
        right = ("true" if true else "false") if x.two_way else x.correct.key
        row = {"ord": i + 1, "id": x.id, "category": x.category, "type": "true_false" if x.two_way else x.kind, "text": x.prompt if true else x.false_prompt, "options": options, "correct_answer": 0 if true else 1, "points": x.worth}
        out.append(row | {"salt": salt, "answer_hash": digest(salt, right), "leaks": leaks, "requested": count} | {k: x.ref.get(k) for k in ("kind", "term", "step_number", "warning_index", "s", "e")})
    return out


SCHEMA = "doc_id long, doc_key string, medical boolean, requested int, ord int, id string, category string, type string, text string, options array<string>, correct_answer int, points int, salt string, answer_hash string, leaks int, kind string, term string, step_number string, warning_index int, s int, e int"
#: What is left of it without texts.
SIZES = "doc_id long, doc_key string, medical boolean, requested int, ord int, id string, type string, options array<int>, correct_answer int, points int"


def attempted(facts_: DataFrame, counts: tuple[int, ...] = (5,), medical: tuple[bool, ...] = (False,), texts: bool = True) -> DataFrame:
    """Questions as `assessments` gives them, or what SIZES holds of them, with ``error``: a run (document, number, kind) that fails is one row with its reason and no question, and harms no other."""
    schema = SCHEMA if texts else SIZES
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc in b.to_dict("records"):
                doc, known = {k: _plain(v) for k, v in doc.items()}, None
                for n in counts:
                    for m in medical:
                        own = {"doc_id": doc["doc_id"], "doc_key": doc["doc_key"], "medical": m, "requested": n}
                        try:
                            known = supported(doc) if known is None else known
                            rows += [own | {"error": None} | r for r in assess(doc, n, m, known, texts)]
                        except Exception as e:
                            rows.append(dict.fromkeys(names) | own | {"error": f"{type(e).__name__}: {str(e)[:160]}"})
            made = pd.DataFrame(rows, columns=[*names, "error"], dtype=object)
            yield made.astype({k: "Int64" for k in ("ord", "correct_answer", "points", "leaks", "warning_index", "s", "e") if k in names})

    return facts_.mapInPandas(run, f"{schema}, error string")


def assessments(facts_: DataFrame, counts: tuple[int, ...] = (5,), medical: tuple[bool, ...] = (False,)) -> DataFrame:
    """Questions of every document for each requested number and with or without the required ones, right options first; see `placed`. Runs that fail have none; see `attempted`."""
    return attempted(facts_, counts, medical).where("error is null").drop("error")


def _plain(v: object) -> object:
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    return [_plain(x) for x in v] if isinstance(v, list) else {k: _plain(x) for k, x in v.items()} if isinstance(v, dict) else v


def placed(questions: DataFrame) -> DataFrame:
    """Questions with their right options where the layout puts them."""
    key = F.concat_ws("|", "doc_key", F.col("doc_id").cast("string"), F.col("medical").cast("string"), F.col("requested").cast("string"))
    df = questions.withColumn("_real", F.col("doc_id")).withColumn("doc_id", key).withColumn("n_options", F.size("options"))
    df = Z.laid(df).drop("worst").withColumn("correct_answer", F.coalesce("position", "correct_answer"))
    rest = F.slice("options", F.lit(2), F.size("options"))
    moved = F.concat(F.slice(rest, F.lit(1), F.col("position")), F.slice("options", 1, 1), F.slice(rest, F.col("position") + 1, F.size("options")))
    return df.withColumn("options", F.when(F.col("position").isNull(), F.col("options")).otherwise(moved)).withColumn("doc_id", F.col("_real")).drop("_real", "position")


def relaid(questions: DataFrame) -> DataFrame:
    """Edited questions laid out anew: right options first, wrong ones in the order of a digest, then `placed`. Two-way items stay as they are."""
    right = F.get("options", F.col("correct_answer"))
    wrong = F.filter("options", lambda o, i: i != F.col("correct_answer"))
    seed = lambda o: F.sha2(F.concat_ws("|", "doc_key", "id", T.option_key(o)), 256)
    wrong = F.transform(F.array_sort(F.transform(wrong, lambda o: F.struct(seed(o).alias("d"), o.alias("o")))), lambda x: x["o"])
    many = F.col("type") != "true_false"
    df = questions.withColumn("options", F.when(many, F.concat(F.array(right), wrong)).otherwise(F.col("options")))
    return placed(df.withColumn("correct_answer", F.when(many, 0).otherwise(F.col("correct_answer"))))


def sweep(docs: DataFrame, risks: DataFrame, counts: tuple[int, ...] = (5, 8)) -> DataFrame:
    """(doc_id, ok, error, steps, warnings, definitions, has_purpose, has_scope, risk, worst, strategy, medical, passing_score, gameable, thin): both kinds of assessment, every number, every strategy.

    A document of which a run fails is a row with ok false and the first reason, without
    scores. ``worst`` is the most that a strategy of SWEPT gets in a run, ``strategy``,
    ``medical`` and ``passing_score`` those of the run that gave it, the first one of equals
    by kind, number and order of SWEPT; gameable compares the two. Facts and questions
    are made once and written to shared storage.
    """
    f = stored(facts(docs), "facts")
    # the one costly step, over all cores however small the table is
    cores = docs.sparkSession.sparkContext.defaultParallelism
    tried = stored(attempted(f if f.rdd.getNumPartitions() >= cores else f.repartition(cores, "doc_id"), counts, (False, True), texts=False), "questions")
    return swept(f, placed(tried.where("error is null").drop("error")), tried.where("error is not null").select("doc_id", "medical", "requested", "error"), risks, F.col("options"))


def swept(facts_: DataFrame, questions: DataFrame, errors: DataFrame, risks: DataFrame, lengths: Column | None = None) -> DataFrame:
    """The rows of `sweep` from facts, laid-out questions, failed runs and risks; ``lengths``: of the questions' options, where these aren't texts."""
    run = ["doc_id", "medical", "requested"]
    lengths = F.transform("options", lambda o: F.length(o)) if lengths is None else lengths
    q = questions.withColumn("_run", F.struct(*run)).select(F.col("_run").alias("doc_id"), "type", "n_options", "correct_answer", "points", lengths.alias("lengths"))
    scores = Z.run_scores(q, F.col("lengths"))
    order = lambda name: F.array_position(F.array(*map(F.lit, Z.SWEPT)), name)
    ranked = lambda x: F.struct(x["score"].alias("score"), (~F.col("doc_id.medical")).alias("base"), (-F.col("doc_id.requested")).alias("n"), (-order(x["strategy"])).alias("o"), x["strategy"].alias("strategy"), F.col("doc_id.medical").alias("medical"))
    best = F.array_max(F.transform(F.filter("scores", lambda x: x["strategy"].isin(*Z.SWEPT)), ranked))
    worst = scores.select(F.col("doc_id.doc_id").alias("_doc"), best.alias("x"), (F.col("n") < F.col("doc_id.requested")).alias("short")).groupBy(F.col("_doc").alias("doc_id")).agg(F.max("x").alias("x"), F.count_if("short").alias("thin"))
    worst = worst.select("doc_id", F.col("x.score").alias("worst"), F.col("x.strategy").alias("strategy"), F.col("x.medical").alias("medical"), "thin")
    failed = errors.groupBy("doc_id").agg(F.min(F.struct("medical", "requested", "error"))["error"].alias("error"))
    n = lambda c: F.size(c).cast("long").alias(c)
    out = facts_.select("doc_id", n("steps"), n("warnings"), n("definitions"), (F.size("purpose") > 0).alias("has_purpose"), (F.size("scope") > 0).alias("has_scope"))
    out = out.join(risks.select("doc_id", "risk").hint("merge"), "doc_id", "left")
    for own in (worst, failed):
        out = out.join(own.hint("merge"), "doc_id", "left")
    ok = F.col("error").isNull()
    when = lambda c, x=None: F.when(ok, F.col(c) if x is None else F.coalesce(c, F.lit(x))).alias(c)
    mark = F.when(F.col("medical"), Z.PASS_MARKS[True]).otherwise(Z.PASS_MARKS[False])
    return out.select(
        "doc_id", ok.alias("ok"), "error", "steps", "warnings", "definitions", "has_purpose", "has_scope", "risk", when("worst", 0.0), when("strategy"), when("medical"), F.when(ok & F.col("strategy").isNotNull(), mark).alias("passing_score"),
        F.when(ok, F.coalesce(F.col("worst") >= mark, F.lit(False))).alias("gameable"), when("thin", 0),
    )
