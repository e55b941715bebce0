"""Words of documents that resemble words of queries: 0.7 Jaro-Winkler + 0.3 Levenshtein similarity.

Only pairs that can reach the least score are made. Words of lengths m and n with c letters in common (each as often as both have it) have a Jaro
similarity of at most (c/m + c/n + 1)/3 and a Levenshtein distance of at least max(m, n) - c; so each pair of lengths needs some number of common letters, or is out.
Two words with as many share one of their first m - need + 1 and n - need + 1 letters in any fixed order: those are posted and joined,
by both lengths and the letter. What meets is held against the exact number of common letters, then the exact Levenshtein distance and common
beginning, and only the rest is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window as W

from factloom.operators.search import fold
from factloom.sources.files import stored

TOKEN = "[a-z0-9]+"


def jaro_winkler(a: str, b: str) -> float:
    """Up to four equal first letters count, where the plain similarity is above 0.7."""
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    taken, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    n = len(left)
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    plain = (n / len(a) + n / len(b) + (n - moved) / n) / 3
    if plain <= 0.7:
        return plain
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return plain + 0.1 * same * (1 - plain)


@F.pandas_udf(DoubleType())
def _alike(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for one, two in parts:
        yield pd.Series([jaro_winkler(a, b) for a, b in zip(one, two, strict=True)], dtype="float64")


#: rare letters first, so that postings are short; any order gives the same pairs
LETTERS = "qwxf0123456789gjbcyuzhdkmvprtlnsioae"
HOT = 10_000
#: pairs that are told to all tasks; more are joined by a shuffle
LISTED = 100_000


def highest(common: float, m: int, n: int, beginning: int = 4) -> float:
    """The highest score of words of lengths m and n with so many common letters and so long a common beginning."""
    if not common:
        return 0.0
    jaro = (common / m + common / n + 1) / 3
    return 0.7 * (jaro + 0.1 * beginning * (1 - jaro) if jaro > 0.7 else jaro) + 0.3 * common / max(m, n)


def needs(lengths: list[int], least: float) -> list[tuple[int, int, int]]:
    """(m, n, common letters needed) for the lengths m of words and all lengths n of tokens that can reach the least score."""
    out = []
    for m in lengths:
        n = 1
        while True:
            need = next((c for c in range(1, min(m, n) + 1) if highest(c, m, n) >= least - 1e-6), None)
            if need is not None:
                out.append((m, n, need))
            if need is None and n > m:  # longer ones reach less
                break
            n += 1
    return out


def _posted(rows: DataFrame, name: str) -> DataFrame:
    """rows with the letters of a word in the fixed order, numbered by occurrence so that they are all different."""
    ranked = F.array_sort(F.transform(F.split(name, ""), lambda c: F.concat(F.lpad(F.instr(F.lit(LETTERS), c).cast("string"), 2, "0"), c)))
    rows = rows.withColumn("_ranked", F.explode(F.array(ranked)))
    return rows.withColumn(f"{name}_letters", F.transform("_ranked", lambda x, i: F.concat(x, F.lpad((i + 1 - F.array_position("_ranked", x)).cast("string"), 4, "0")))).drop("_ranked")


def candidates(words: DataFrame, tokens: DataFrame, least: float = 0.6) -> DataFrame:
    """word, token and common (letters) of all pairs of words(word) and tokens(token) that have the letters the least score needs; each pair once."""
    spark = words.sparkSession
    lengths = sorted(r[0] for r in words.select(F.length("word")).distinct().collect())  # at most as many as the longest word has letters
    table = spark.createDataFrame(needs(lengths, least), "m int, n int, need int")
    words, tokens = _posted(words.withColumn("m", F.length("word")), "word"), tokens.withColumn("n", F.length("token")).join(F.broadcast(table), "n")
    words = words.join(F.broadcast(table), "m").select("word", "word_letters", "m", "n", F.slice("word_letters", F.lit(1), F.col("m") - F.col("need") + 1).alias("first"))
    tokens = _posted(tokens, "token").select("token", "token_letters", "m", "n", "need", F.slice("token_letters", F.lit(1), F.col("n") - F.col("need") + 1).alias("ahead"))
    pairs = words.select("*", F.explode("first").alias("letter")).join(tokens.select("*", F.explode("ahead").alias("letter")), ["m", "n", "letter"])
    pairs = pairs.where(F.col("letter") == F.array_min(F.array_intersect("first", "ahead")))  # a pair meets at each letter its beginnings share; the first counts
    return pairs.withColumn("common", F.size(F.array_intersect("word_letters", "token_letters"))).where("common >= need").select("word", "token", "common")


def scored(pairs: DataFrame, least: float = 0.6) -> DataFrame:
    """word, token, score of the candidates() that reach it."""
    m, n = F.length("word"), F.length("token")
    close = 1 - F.levenshtein("word", "token") / F.greatest(m, n)
    same = lambda k: F.when((m >= k) & (n >= k) & (F.left("word", F.lit(k)) == F.left("token", F.lit(k))), k)
    pairs = pairs.withColumn("close", close).withColumn("beginning", F.coalesce(same(4), same(3), same(2), same(1), F.lit(0)))
    jaro = (F.col("common") / m + F.col("common") / n + 1) / 3
    winkler = F.when(jaro > 0.7, jaro + 0.1 * F.col("beginning") * (1 - jaro)).otherwise(jaro)
    pairs = pairs.where(0.7 * winkler + 0.3 * F.col("close") >= least - 1e-6)
    return pairs.select("word", "token", F.round(0.7 * _alike("word", "token") + 0.3 * F.col("close"), 6).alias("score")).where(F.col("score") >= least)


def nearest_tokens(docs: DataFrame, queries: DataFrame, least: float = 0.6, top: int = 10) -> DataFrame:
    """doc_id, word, token, score, rank: for each document and query word its most similar tokens (ties: by token).

    Pairs are made of the distinct tokens of the collection that share a character with some word, as all pairs do. If the pairs are few, they are told to all
    tasks and only hits are moved, as the numbers of their pairs, or nothing where documents lie by doc_id; the texts are cut twice, but no tokens are stored. If not, see _dealt().
    """
    words = queries.select(F.explode(F.regexp_extract_all(fold(F.col("query")), F.lit(TOKEN), F.lit(0))).alias("word")).distinct()
    letters = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", ""))).distinct().collect()))  # at most 36
    others = "".join(sorted(set(LETTERS) - set(letters)))
    holding = f"(?<!{TOKEN[:-1]})" + (f"[{others}]*+" if others else "") + f"[{letters}]{TOKEN[:-1]}*+" if letters else TOKEN
    tokens = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(fold(F.col("text")), F.lit(holding), F.lit(0)))).alias("token"))
    known = stored(tokens.groupBy("token").agg(F.count("*").alias("n")), "vocabulary")
    pairs = stored(scored(candidates(words, known.select("token"), least), least), "pairs")
    if pairs.limit(LISTED + 1).count() > LISTED:
        found = _dealt(tokens, known, pairs)
        best = W.partitionBy("doc_id", "word").orderBy(F.col("score").desc(), "token")
        return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("doc_id", "word", "token", "score", "rank")
    place = F.struct("word", (-F.col("score")).alias("falling"), "token")
    numbers = F.dense_rank().over(W.orderBy("word")).alias("word_no"), F.row_number().over(W.orderBy(place)).alias("pair_no")  # of a bounded list
    pairs = stored(pairs.select("word", "token", "score", *numbers), "numbered")
    hits = tokens.join(F.broadcast(pairs.select("token", "word_no", "pair_no")), "token").select("doc_id", "word_no", "pair_no")
    hits = hits.withColumn("rank", F.row_number().over(W.partitionBy("doc_id", "word_no").orderBy("pair_no"))).where(F.col("rank") <= top)
    return hits.join(F.broadcast(pairs.drop("word_no")), "pair_no").select("doc_id", "word", "token", "score", "rank")


def _dealt(tokens: DataFrame, known: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc_id, word, token, score: tokens joined to pairs by a shuffle.

    A token of very many documents is dealt to several tasks: tokens of a ten-thousandth of all rows or more, of which there are ten thousand at most, are
    told to both sides.
    """
    total = known.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(known.where(F.col("n") * HOT >= total).select("token", F.ceil(F.col("n") * HOT / max(1, total)).cast("int").alias("parts")))
    dealt = pairs.join(hot, "token", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    tokens = tokens.join(hot, "token", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    return tokens.join(dealt, ["token", "part"]).select("doc_id", "word", "token", "score")
