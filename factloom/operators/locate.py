"""Places: between a normalised text and its original, and of values in documents. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import textnorm as N
from factloom.functions import values as V
from factloom.operators.patterns import CAPS, MONEY, SMALL

_RUNS = "array<struct<normal:int,original:int>>"
BLOCK = 1000  # characters that are aligned at a time: a fold copies its state at each step, so the runs of a block are kept apart
PIECE = 25  # characters that are taken at once where they are the next ones of the normalised text


def _taken(state: Column, char: Column, chars: Column) -> Column:
    """The state after a character of the original: it is taken if it is the next one of the normalised text, and begins a run if the one before was not."""
    same = F.coalesce(F.get(chars, state["normal"]) == char, F.lit(False))
    begins = F.array(F.struct(state["normal"].alias("normal"), state["original"].alias("original"))).cast(_RUNS)
    return F.struct(
        F.when(same, state["normal"] + 1).otherwise(state["normal"]).alias("normal"), (state["original"] + 1).alias("original"), same.alias("within"),
        F.when(same & ~state["within"], F.concat(state["runs"], begins)).otherwise(state["runs"]).alias("runs"),
    )


def _piece_taken(state: Column, piece: Column, chars: Column) -> Column:
    """The state after a piece of the original: at once if it is what comes next in the normalised text, else character by character."""
    begins = F.array(F.struct(state["normal"].alias("normal"), state["original"].alias("original"))).cast(_RUNS)

    def taken(letters: Column) -> Column:
        n = F.size(letters)
        runs = F.when(state["within"], state["runs"]).otherwise(F.concat(state["runs"], begins))
        whole = F.struct((state["normal"] + n).alias("normal"), (state["original"] + n).alias("original"), F.lit(True).alias("within"), runs.alias("runs"))
        return F.when(F.slice(chars, state["normal"] + 1, n) == letters, whole).otherwise(F.aggregate(letters, state, lambda acc, c: _taken(acc, c, chars)))

    return N.once(F.split(piece, ""), taken)


def _block_taken(state: Column, block: Column, chars: Column) -> Column:
    none = F.array().cast(_RUNS).alias("runs")
    begin = F.struct(state["normal"].alias("normal"), state["original"].alias("original"), state["within"].alias("within"), none)
    end = F.aggregate(F.regexp_extract_all(block, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), begin, lambda acc, piece: _piece_taken(acc, piece, chars))
    # a fold of one step binds the block's end, so that it is made once
    return F.aggregate(F.array(end), state, lambda acc, e: F.struct(e["normal"].alias("normal"), e["original"].alias("original"), e["within"].alias("within"), F.concat(acc["runs"], e["runs"]).alias("runs")))


def with_offset_map(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with normal (the normalised text) and offset_map: how its places lie in text, a struct of runs, size and until.

    runs(normal, original) tell where stretches of the normalised text begin that lie unbroken in text, found from left to right; the first `until` places
    lie in them, later ones, up to size (the length of the normalised text), are the same in both. Null text has no places.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # exploded arrays of one: what is made there is a column for what follows, not made again in each step of a fold
    rows = docs.withColumn("_clean", F.explode(F.array(N.remove_markdown(whole))))
    rows = rows.withColumn("_made", F.explode(F.array(F.struct(F.when(F.col("_clean") != whole, F.split("_clean", "")).alias("chars"), F.lower(N.remove_diacritics(F.col("_clean"))).alias("normal")))))
    n, size, chars = F.length("_clean"), F.length("_made.normal"), F.col("_made.chars")
    state = F.struct(F.lit(0).alias("normal"), F.lit(0).alias("original"), F.lit(False).alias("within"), F.array().cast(_RUNS).alias("runs"))
    blocks = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    aligned = F.aggregate(blocks, state, lambda acc, block: _block_taken(acc, block, chars), lambda acc: acc["runs"])
    unbroken = F.array(F.struct(F.lit(0).alias("normal"), F.lit(0).alias("original"))).cast(_RUNS)
    runs = F.when(n == 0, F.array().cast(_RUNS)).when(whole == F.col("_clean"), unbroken).otherwise(aligned)
    made = F.struct(runs.alias("runs"), size.alias("size"), F.least(size, n).alias("until"))
    normal = F.when(F.col(text).isNotNull(), F.col("_made.normal"))
    return rows.withColumn("offset_map", F.explode(F.array(made))).withColumn("normal", normal).drop("_clean", "_made")


def _counted(n: Column) -> Column:
    """0, 1, and so on: n numbers."""
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def index_map(mapped: Column) -> Column:
    """An offset map with one number for each place of the normalised text, for those who need it so."""
    runs, until = mapped["runs"], mapped["until"]
    ends = F.concat(F.slice(F.transform(runs, lambda r: r["normal"]), 2, F.size(runs)), F.array(until))
    places = F.flatten(F.zip_with(runs, ends, lambda r, end: F.transform(_counted(F.least(end, until) - r["normal"]), lambda i: r["original"] + i)))
    return F.concat(places, F.transform(_counted(mapped["size"] - until), lambda i: until + i))


def reverse_map(maps: DataFrame) -> DataFrame:
    """doc_id, original, normalized: for each original place its normalised ones, ascending; maps(doc_id, offset_map). No shuffle: places belong to one document."""
    rows = maps.select("doc_id", F.col("offset_map.until").alias("until"), F.col("offset_map.size").alias("size"), index_map(F.col("offset_map")).alias("places"))
    rows = rows.withColumn("aligned", F.slice("places", F.lit(1), F.col("until")))
    ahead = F.transform(_counted(F.col("size") - F.col("until")), lambda i: F.col("until") + i)  # places beyond the runs
    rest = F.when(F.col("size") > F.col("until"), F.filter(ahead, lambda o: ~F.array_contains("aligned", o))).otherwise(F.array().cast("array<int>"))
    rows = rows.select("doc_id", "until", "size", F.posexplode(F.concat("aligned", rest)).alias("i", "original"))
    aligned, late = F.col("i") < F.col("until"), (F.col("original") >= F.col("until")) & (F.col("original") < F.col("size"))  # late: places that are also their own
    normalized = F.when(aligned & late, F.array("i", "original")).when(aligned, F.array("i")).otherwise(F.array("original"))
    return rows.select("doc_id", "original", normalized.alias("normalized"))


def original_place(place: Column, mapped: Column) -> Column:
    """A place of the normalised text in the original: bisection on the runs of its offset map; places outside stay as they are."""
    runs = mapped["runs"]
    state = F.struct(F.lit(0).alias("low"), F.size(runs).alias("high"), runs.alias("runs"), place.alias("place"))  # the run sought is at low or above, below high

    def halved(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        above = F.coalesce(F.get(acc["runs"], middle)["normal"] <= acc["place"], F.lit(False))
        go = acc["high"] - acc["low"] > 1
        return F.struct(F.when(go & above, middle).otherwise(acc["low"]).alias("low"), F.when(go & ~above, middle).otherwise(acc["high"]).alias("high"), acc["runs"].alias("runs"), acc["place"].alias("place"))

    steps = F.sequence(F.lit(1), F.length(F.bin(F.size(runs))))
    run = F.when(F.size(runs) == 1, F.get(runs, F.lit(0))).otherwise(F.aggregate(steps, state, halved, lambda acc: F.get(acc["runs"], acc["low"])))
    return F.when((place >= 0) & (place < mapped["until"]), run["original"] + place - run["normal"]).otherwise(place)


def original_range(start: Column, end: Column, mapped: Column) -> Column:
    return F.struct(original_place(start, mapped).alias("start"), (original_place(end - 1, mapped) + 1).alias("end"))


def quoted(value: Column) -> Column:
    """value as an expression that matches it alone."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def starts_of(text: Column, values: Column) -> Column:
    """The places of text where any of the values (an array, none empty) begins, overlapping ones too: one pass over the text, whatever their number.

    The text is cut before each such place; the cut at its very beginning, which split leaves out, is seen to.
    """
    any_of = F.array_join(F.transform(values, quoted), "|")
    cut = F.split(text, F.concat(F.lit("(?="), any_of, F.lit(")")), -1)
    first = F.when(F.exists(values, lambda v: text.startswith(v)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    state = F.struct(F.lit(0).alias("at"), first.alias("out"))

    def add(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.length(piece)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(F.aggregate(F.slice(cut, 1, F.greatest(F.size(cut) - 1, F.lit(0))), state, add, lambda acc: acc["out"]))


def value_places(values: DataFrame, documents: DataFrame) -> DataFrame:
    """All places, overlapping ones too, of each value(doc_id, value, type) in its document, if the original text there fits the type.

    Returns doc_id, value, type, start, end, text, normalized_start, normalized_end. A document's distinct values are gathered
    first, so that its text is normalised once and searched once for all of them. Empty values have no places.
    """
    needle = F.lower(N.remove_diacritics(V.normalize_value(F.col("value"), F.col("type"))))
    wanted = values.where(F.coalesce("value", F.lit("")) != "").select("doc_id", F.struct("value", "type", needle.alias("needle")).alias("w")).where(F.col("w.needle") != "")
    wanted = wanted.groupBy("doc_id").agg(F.collect_set("w").alias("wanted"))
    docs = documents.join(wanted, "doc_id").select("doc_id", "text", "wanted", F.array_distinct(F.transform("wanted", lambda w: w["needle"])).alias("needles"))
    docs = with_offset_map(docs)
    # a place, the stretch of the normalised text that begins there, as long as the longest value
    longest = F.array_max(F.transform("needles", F.length))
    docs = docs.withColumn("at", F.explode(F.array(starts_of(F.col("normal"), F.col("needles"))))).where(F.size("at") > 0).withColumn("longest", longest)
    docs = docs.select("doc_id", "text", "wanted", "at", F.transform("at", lambda p: F.substring(F.col("normal"), p + 1, F.col("longest"))).alias("there"), "offset_map")
    hits = F.zip_with("at", "there", lambda p, t: F.transform(F.filter("wanted", lambda w: t.startswith(w["needle"])), lambda w: F.struct(p.alias("at"), w.alias("w"))))
    rows = docs.select("doc_id", "text", "offset_map", F.explode(F.flatten(hits)).alias("h")).select("doc_id", "text", "offset_map", "h.at", "h.w")
    end = F.col("at") + F.length("w.needle")
    rows = rows.withColumn("place", original_range(F.col("at"), end, F.col("offset_map")))
    found = F.substring("text", F.col("place.start") + 1, F.col("place.end") - F.col("place.start"))
    fits = F.lit(True)
    for kind, rule in V.DETECTORS:
        fits = F.when(F.col("w.type") == kind, rule(F.col("found"))).otherwise(fits)
    rows = rows.withColumn("found", found).where(fits)
    return rows.select("doc_id", "w.value", "w.type", "place.start", "place.end", F.col("found").alias("text"), F.col("at").alias("normalized_start"), end.alias("normalized_end"))


_CURRENCY = V.CURRENCY
#: only the currency is matched without regard to case: a class that is, is slow in Java, and digits and spaces have none
_AMOUNT = rf"{MONEY}(?iu:{_CURRENCY})?"
_NO_CURRENCY = rf"{N.SP}*+(?iu:{_CURRENCY}){N.SP}*+$"
#: kinds of values in an answer, in order of preference
KINDS = [
    ("birthNumber", r"[0-9]{6}/[0-9]{3,4}"),
    ("name", rf"{CAPS}{SMALL}+{N.SP}+{CAPS}{SMALL}+"),
    ("amount", _AMOUNT),
    ("percentage", rf"[0-9]{{1,3}}(?:[.,][0-9]{{1,2}})?{N.SP}*%"),
    ("account", r"[0-9]{2,10}/[0-9]{4}"),
]


def _of_kind(found: Column, kind: str) -> Column:
    return F.transform(found, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))


def individual_values(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, start, end, kind, text: values in the answers' texts at their first place in the document.

    Case is ignored. An amount that is absent is sought without its currency, and then reaches as far as the document's amount
    there does. Of values with the same place the first kind counts. answers(doc_id, answer).
    """
    rows = answers.join(documents.select("doc_id", "text"), "doc_id").withColumn("low", F.lower("text"))
    found = [_of_kind(F.regexp_extract_all("answer", F.lit(regex), F.lit(0)), kind) for kind, regex in KINDS]
    rows = rows.select("doc_id", "text", "low", F.posexplode(F.concat(*found)).alias("ord", "x")).select("doc_id", "text", "low", "ord", "x.*")
    amount = F.col("kind") == "amount"
    v = F.when(amount, N.js_trim(F.regexp_replace("v", f"{N.SP}+", " "))).otherwise(F.col("v"))
    bare = F.when(amount, N.js_trim(F.regexp_replace("v", _NO_CURRENCY, "")))
    rows = rows.withColumn("v", v).withColumn("at", F.instr("low", F.lower("v")))
    rows = rows.withColumn("bare_at", F.when(F.col("at") > 0, 0).otherwise(F.coalesce(F.instr("low", F.lower(bare)), F.lit(0))))  # sought only where it is needed
    there = F.regexp_extract(F.substring("text", F.col("bare_at"), F.length("text")), rf"^{_AMOUNT}", 0)
    size = F.when(F.col("at") > 0, F.length("v")).when(F.col("bare_at") > 0, F.length(there))
    start = F.when(F.col("at") > 0, F.col("at")).otherwise(F.col("bare_at")) - 1
    # an exploded array of one: a filter on plain columns would be moved below them, with all that they are made of
    rows = rows.select("doc_id", "text", "ord", "kind", F.explode(F.array(F.struct(start.alias("start"), size.alias("size")))).alias("p")).select("doc_id", "text", "ord", "kind", "p.*").where("start >= 0 and size > 0")
    rows = rows.select("doc_id", "start", (F.col("start") + F.col("size")).alias("end"), F.struct("ord", "kind", F.substring("text", F.col("start") + 1, F.col("size")).alias("text")).alias("x"))
    return rows.groupBy("doc_id", "start", "end").agg(F.min("x").alias("x")).select("doc_id", "start", "end", "x.kind", "x.text")
