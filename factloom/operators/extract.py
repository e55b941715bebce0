"""Mentions of patterns and clauses in documents: one pass over the texts, no shuffle, built-in functions only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.textnorm import fold, js_trim
from factloom.operators import patterns as P

MARK = "\x01"


def found(text: Column, regex: str) -> Column:
    """The text cut before and after each match of the pattern: gap, match, gap, and so on to a last gap. Matches must not be empty.

    Matches are put between marks and the text is cut at these, so the pattern runs once; a text that holds the mark itself is
    searched for the matches and for the gaps.
    """
    return F.when(text.contains(MARK), _searched_twice(text, regex)).otherwise(F.split(_marked(text, regex), MARK, -1))


def _marked(text: Column, regex: str) -> Column:
    return F.regexp_replace(text, regex, f"{MARK}$0{MARK}")


def _searched_twice(text: Column, regex: str) -> Column:
    gaps, matches = F.split(text, regex, -1), F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    pairs = F.flatten(F.zip_with(gaps, matches, lambda gap, match: F.array(gap, match)))  # the last gap has no match beside it
    return F.filter(pairs, lambda x: x.isNotNull())


def placed(docs: DataFrame, sought: list[tuple[str, int, str]], *keep: str) -> DataFrame:
    """The kept columns, pattern, pattern_no, match_ord, start, end (0-based, exclusive, code points), value: all matches of (pattern, pattern_no, regex)."""
    rows = _placed(docs, sought, *keep)
    names, numbers = (F.array(*[F.lit(s[j]) for s in sought]) for j in (0, 1))
    return rows.select(*keep, F.get(names, F.col("_no")).alias("pattern"), F.get(numbers, F.col("_no")).alias("pattern_no"), "match_ord", "start", "end", "value")


def _placed(docs: DataFrame, sought: list[tuple[str, int, str]], *keep: str) -> DataFrame:
    """placed(), with _no, the place in the list of what is sought, for its pattern and number.

    A text is searched for those expressions alone whose strings (patterns.NEEDS) it holds. A row for each that occurs in a text, and only there the
    text is cut, as found() does; then one for each match. Starts are running sums of the lengths of the gaps and the matches before.
    """

    def add(acc: Column, x: Column) -> Column:
        return F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    text, low = F.col("text"), F.col("_low")

    def searched(regex: str) -> list[Column]:
        may = reduce(or_, [low.contains(x) for x in P.NEEDS[regex]]) | F.col("_forms") if regex in P.NEEDS else F.lit(True)
        return [F.when(~F.col("_odd") & may, _marked(text, regex)).alias("marked"), F.when(F.col("_odd"), _searched_twice(text, regex)).alias("cut")]

    cuts = F.array(*[F.struct(F.lit(i).alias("i"), *searched(regex)) for i, (_, _, regex) in enumerate(sought)])
    occurs = lambda x: F.coalesce(x["marked"].contains(MARK), F.size(x["cut"]) > 1, F.lit(False))
    forms = reduce(or_, [text.contains(x) for x in P.ODD_FORMS])
    rows = docs.select(*dict.fromkeys([*keep, "text"]), F.lower("text").alias("_low"), forms.alias("_forms"), text.contains(MARK).alias("_odd"))
    rows = rows.select(*keep, F.explode(F.filter(cuts, occurs)).alias("m"))

    def matches(cut: Column) -> Column:
        starts = F.aggregate(F.slice(cut, F.lit(1), F.size(cut) - 1), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), add, lambda acc: acc["out"])
        pairs = F.zip_with(starts, cut, lambda start, value: F.struct(start.alias("start"), value.alias("value")))
        one = F.array(F.struct(F.length(cut[0]).alias("start"), cut[1].alias("value")))  # as most have
        return F.when(F.size(cut) == 3, one).otherwise(F.filter(pairs, lambda x, i: i % 2 == 1))

    rows = rows.select(*keep, F.col("m.i").alias("_no"), F.posexplode(V.once(F.coalesce(F.col("m.cut"), F.split("m.marked", MARK, -1)), matches)).alias("match_ord", "x"))
    start, value = F.col("x.start"), F.col("x.value")
    return rows.select(*keep, "_no", "match_ord", start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))


def context(text: Column, start: Column, end: Column, radius: Column | int) -> Column:
    radius = radius if isinstance(radius, Column) else F.lit(radius)
    low = F.greatest(start - radius, F.lit(0))
    return js_trim(F.substring(text, low + 1, end + radius - low))


def _by_pattern(no: Column, specs, value: Column, what: str) -> Column:
    """What the specs, the first ones of those sought, say of a value."""
    out = F.lit(True) if what == "valid" else value
    for i, s in enumerate(specs):
        said = {"valid": lambda s: F.lit(True) if s.valid is None else s.valid(value), "normal": lambda s: s.normal(value)}[what](s)
        if said is not value and not (what == "valid" and s.valid is None):
            out = F.when(no == i, said).otherwise(out)
    return out


def checked(docs: DataFrame, specs=P.PATTERNS) -> DataFrame:
    """doc_id, pattern, start, end, value, valid: all matches of the patterns, with what their validators say."""
    rows = _placed(docs, [(s.name, 0, s.regex) for s in specs], "doc_id")
    pattern = F.get(F.array(*[F.lit(s.name) for s in specs]), F.col("_no"))
    return rows.select("doc_id", pattern.alias("pattern"), "start", "end", "value", _by_pattern(F.col("_no"), specs, F.col("value"), "valid").alias("valid"))


def mentions(docs: DataFrame, names: list[str] | None = None, specs=P.PATTERNS, clauses=P.CLAUSES, folded: bool = False) -> DataFrame:
    """doc_id, pattern, type, label, value, original_value, start, end, confidence, context, clause_type, pattern_no, match_ord.

    names: the patterns and clauses that some query needs (all if None); others are not run. folded: with folded_context too, taken from the text folded once
    where folding keeps all places, else made of the context.
    """
    used = [s for s in specs if names is None or s.name in names]
    told = [(c, no, f"(?iu){r}") for c, _, rs in clauses if names is None or c in names for no, r in enumerate(rs)]
    if not used and not told:
        raise ValueError("no such pattern")
    sought = [(s.name, 0, s.regex) for s in used] + told
    if folded:  # a final sigma depends on what follows, marks by themselves become nothing
        docs = docs.select("doc_id", "text", fold(F.col("text")).alias("_folded")).withColumn("_folded", F.when((F.length("_folded") == F.length("text")) & ~F.col("text").contains("Σ"), F.col("_folded")))
    rows = _placed(docs, sought, "doc_id", "text", *(["_folded"] if folded else []))
    # what is sought is known by its number: what is true of it is looked up in lists
    no, value, clause = F.col("_no"), F.col("value"), F.col("_no") >= len(used)
    rows = rows.where(_by_pattern(no, used, value, "valid"))
    around = [context(F.col(c), F.col("start"), F.col("end"), F.when(clause, 200).otherwise(100)) for c in ("text", "_folded")]
    rows = rows.withColumns({"context": around[0]} | ({"folded_context": F.coalesce(around[1], fold(around[0]))} if folded else {})).drop("text", "_folded")
    keyed = [(i, s) for i, s in enumerate(used) if s.keywords]
    # the context is named once here, so that it is made for those with keywords alone where nothing else asks for it
    rows = rows.withColumn("_around", F.when(no.isin([i for i, _ in keyed]), F.lower("context")) if keyed else F.lit(None).cast("string"))
    close = F.lit(False)
    for i, s in keyed:
        close = F.when(no == i, reduce(or_, [F.col("_around").contains(k) for k in s.keywords])).otherwise(close)
    sure = F.when(clause, F.lit(0.9)).otherwise(F.least(F.lit(1.0), F.lit(0.8) + F.lit(0.15) + F.when(close, 0.05).otherwise(0.0)))
    by_type = {s.type: s.label for s in specs if s.label} | {c: label for c, label, _ in clauses}
    labels = [by_type.get(s.type, P.DEFAULT_LABEL) for s in used] + [by_type.get(c, P.DEFAULT_CLAUSE) for c, _, _ in told]
    listed = lambda xs: F.get(F.array(*map(F.lit, xs)), no)
    part = F.coalesce(F.lit(None).cast("string"), *[F.when(no == len(used) + i, F.regexp_extract(value, regex, 1)) for i, (_, _, regex) in enumerate(told)])
    normal = F.when(clause, js_trim(part)).otherwise(_by_pattern(no, used, value, "normal"))
    # one projection: the lambda in it keeps these long expressions out of a generated method that is too large to be compiled
    named = {"pattern": [s.name for s in used] + [c for c, _, _ in told], "type": [s.type for s in used] + [c for c, _, _ in told], "label": labels, "pattern_no": [0] * len(used) + [i for _, i, _ in told]}
    rows = rows.withColumns({k: listed(v) for k, v in named.items()} | {"clause_type": clause, "confidence": sure, "original_value": value, "value": normal})
    rows = rows.where(~F.col("clause_type") | (F.col("value") != ""))  # gaps that were passed over
    made = ["doc_id", "pattern", "type", "label", "value", "original_value", "start", "end", "confidence", "context", "clause_type", "pattern_no", "match_ord"]
    return rows.select(*made, *(["folded_context"] if folded else []))
