"""Registered queries of single rules, ranking steps and fuzzy words, each beside its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import answers, extract, fuzzy, search
from factloom.operators import patterns as P
from factloom.plans.queries import _BIRTH, _CLAUSES, _EXT, _INTENT_SQL, _Q, ORACLES, _places, query, questions
from factloom.sources import corpus
from factloom.sources.corpus import with_contracts


def _raw(i: int) -> tuple[str, str, str]:
    """(all matches of a pattern, validity, normal form)"""
    name, regex, valid, normal = _EXT[i]
    if regex is None:  # no look-ahead in RE2
        rows = rf"SELECT p.* FROM ({_places(r'\b\d+/\d+\b', 0, 0)}) p JOIN contracts USING (doc_id) WHERE NOT regexp_matches(substr(text, CAST(s AS BIGINT) + length(value) + 1), '^\s*\d{{3}}')"
        return rows, f"NOT {_BIRTH}", "value"
    return _places(regex, 0, 0), valid, normal


_ALL = range(len(_EXT))
_CHECKED = " UNION ALL ".join(f"SELECT doc_id, '{_EXT[i][0]}' AS pattern, CAST(s AS INTEGER) AS start_pos, value AS original_value, {_raw(i)[1]} AS valid FROM ({_raw(i)[0]})" for i in _ALL)
_NORMAL = " UNION ALL ".join(f"SELECT '{_EXT[i][0]}' AS pattern, value AS original_value, {_raw(i)[2]} AS value FROM ({_raw(i)[0]}) WHERE {_raw(i)[1]}" for i in _ALL)
#: every mention: type, label, radius of its context, normal value and place
_MENTIONS = " UNION ALL ".join(
    [
        f"SELECT doc_id, '{s.name}' AS pattern, '{s.type}' AS type, '{s.label if s.label else P.DEFAULT_LABEL}' AS label, 100 AS radius, {_raw(i)[2]} AS value, CAST(s AS INTEGER) AS start_pos, CAST(s + length(value) AS INTEGER) AS end_pos, 0 AS pattern_no FROM ({_raw(i)[0]}) WHERE {_raw(i)[1]}"
        for i, s in enumerate(P.PATTERNS)
    ]
    + [
        rf"SELECT doc_id, '{name}', '{name}', '{label}', 200, regexp_replace(regexp_replace(part, '^\s+', ''), '\s+$', ''), CAST(s AS INTEGER), CAST(s + length(value) AS INTEGER), pattern_no FROM ({_places('(?i)' + r, no, 1)})"
        for (name, label, _), regexes in zip(P.CLAUSES, _CLAUSES, strict=True)
        for no, r in enumerate(regexes)
    ]
)


@query("VAL-14", with_contracts(f"m AS ({_CHECKED}) SELECT * FROM m"))
def val_14(spark, d):
    return extract.checked(corpus.contracts(spark, d)).select("doc_id", "pattern", F.col("start").alias("start_pos"), F.col("value").alias("original_value"), "valid")


@query("VAL-15", with_contracts(f"m AS ({_NORMAL}) SELECT pattern, original_value, value, count(*) AS n FROM m GROUP BY ALL"))
def val_15(spark, d):
    m = extract.mentions(corpus.contracts(spark, d), [s.name for s in P.PATTERNS])
    return m.groupBy("pattern", "original_value", "value").agg(F.count("*").alias("n"))


@query("EXT-19", with_contracts(f"m AS ({_MENTIONS}) SELECT pattern, type, label, count(*) AS n FROM m GROUP BY ALL"))
def ext_19(spark, d):
    return extract.mentions(corpus.contracts(spark, d)).groupBy("pattern", "type", "label").agg(F.count("*").alias("n"))


@query("SET-01", with_contracts(f"m AS ({_MENTIONS}) SELECT doc_id, pattern, value, start_pos, end_pos FROM m"))
def set_01(spark, d):
    return extract.mentions(corpus.contracts(spark, d)).select("doc_id", "pattern", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("SET-02", with_contracts(f"m AS ({_MENTIONS}) SELECT DISTINCT doc_id, start_pos, end_pos FROM m"))
def set_02(spark, d):
    return extract.mentions(corpus.contracts(spark, d)).select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos")).distinct()


# -- ranking -----------------------------------------------------------------------------------------------------------
_CONTEXT = "trim(substr(text, CAST(greatest(start_pos - radius, 0) AS BIGINT) + 1, CAST(end_pos + radius - greatest(start_pos - radius, 0) AS BIGINT)), ' ' || chr(10))"
_KEYED = " OR ".join(f"pattern = '{s.name}' AND contains(lower(context), '{k}')" for s in P.PATTERNS for k in s.keywords)
_TYPED = " OR ".join(f"type = '{t}' AND regexp_matches(folded, '{r}')" for t, r in P.RELEVANT.items())
_ONCE = f"""{_INTENT_SQL}, m AS (SELECT v.*, {_CONTEXT} AS context FROM ({_MENTIONS}) v JOIN contracts USING (doc_id)), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query_id, start_pos, end_pos, value ORDER BY intent_ord, pattern_no, start_pos) AS n
    FROM m JOIN intents USING (pattern)), once AS (SELECT *, CASE WHEN radius = 200 THEN 0.9 WHEN {_KEYED} THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence, lower(strip_accents(context)) AS around FROM a JOIN q USING (query_id) WHERE n = 1),
    scored AS (SELECT *, (CASE WHEN contains(folded, lower(strip_accents(value))) THEN 0.5 ELSE 0 END + CASE WHEN {_TYPED} THEN 0.3 ELSE 0 END
    + CASE WHEN context <> '' AND len(list_filter(string_split(folded, ' '), lambda w: contains(around, w))) > 0 THEN 0.2 ELSE 0 END)::DOUBLE AS relevance FROM once),
    best AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, query_id ORDER BY confidence DESC, relevance DESC, intent_ord, pattern_no, start_pos) AS INTEGER) AS rank FROM scored)"""
ORACLES["WIN-03"] = with_contracts(f"{_ONCE} SELECT doc_id, query_id, rank, pattern, label, value, start_pos, end_pos, confidence, round(relevance, 6) AS relevance FROM best WHERE rank <= 10")
ORACLES["WIN-04"] = with_contracts(f"""{_ONCE}, f AS (SELECT doc_id, query_id, count(*) AS n, max(confidence) AS confidence FROM best WHERE rank <= 10 GROUP BY 1, 2)
    SELECT c.doc_id, t.query_id, coalesce(n, 0) AS n, coalesce(confidence, 0)::DOUBLE AS confidence FROM contracts c CROSS JOIN {_Q} LEFT JOIN f ON f.doc_id = c.doc_id AND f.query_id = t.query_id""")


def _first_ones(spark, d):
    return search.deduplicated(extract.mentions(corpus.contracts(spark, d), folded=True), search.intents(questions(spark)), lie=True)


@query("WIN-01", with_contracts(f"{_ONCE} SELECT doc_id, query_id, pattern, value, start_pos, end_pos FROM once"))
def win_01(spark, d):
    return _first_ones(spark, d).select("doc_id", "query_id", "pattern", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("WIN-02", with_contracts(f"{_ONCE} SELECT doc_id, query_id, pattern, start_pos, value, round(relevance, 6) AS relevance FROM scored"))
def win_02(spark, d):
    return _first_ones(spark, d).select("doc_id", "query_id", "pattern", F.col("start").alias("start_pos"), "value", F.round("relevance", 6).alias("relevance"))


# -- all mentions, whole texts, all kinds of answers --------------------------------------------------------------------
@query("EXT-17", with_contracts(f"m AS ({_MENTIONS}) SELECT doc_id, pattern, start_pos, end_pos, {_CONTEXT} AS context FROM m JOIN contracts USING (doc_id)"))
def ext_17(spark, d):
    return extract.mentions(corpus.contracts(spark, d)).select("doc_id", "pattern", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "context")


@query("EXT-18", with_contracts(f"m AS (SELECT v.*, {_CONTEXT} AS context FROM ({_MENTIONS}) v JOIN contracts USING (doc_id)) SELECT doc_id, pattern, start_pos, end_pos, CASE WHEN radius = 200 THEN 0.9 WHEN {_KEYED} THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence FROM m"))
def ext_18(spark, d):
    return extract.mentions(corpus.contracts(spark, d)).select("doc_id", "pattern", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.round("confidence", 6).alias("confidence"))


@query("JOI-01", with_contracts(f"{_INTENT_SQL}, m AS ({_MENTIONS}) SELECT query_id, pattern, count(*) AS n FROM m JOIN intents USING (pattern) GROUP BY ALL"))
def joi_01(spark, d):
    counts = extract.mentions(corpus.contracts(spark, d)).groupBy("pattern").agg(F.count("*").alias("n"))  # before they meet the queries
    return counts.join(search.intents(questions(spark)), "pattern").groupBy("query_id", "pattern").agg(F.sum("n").alias("n"))


@query("JOI-01-rows", with_contracts(f"{_INTENT_SQL}, m AS ({_MENTIONS}) SELECT doc_id, query_id, intent_ord, pattern, value, start_pos, end_pos, pattern_no FROM m JOIN intents USING (pattern)"))
def joi_01_rows(spark, d):
    m = extract.mentions(corpus.contracts(spark, d)).join(search.intents(questions(spark)), "pattern")
    return m.select("doc_id", "query_id", "intent_ord", "pattern", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "pattern_no")


@query("QRY-02-whole", "SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN text || ' (hledat také: {v})'" for k, v in P.WIDER.items()) + " ELSE text END AS widened FROM documents UNION ALL "
    + with_contracts("w AS (SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{k}') THEN text || ' (hledat také: {v})'" for k, v in P.WIDER.items()) + " ELSE text END AS widened FROM contracts) SELECT * FROM w").join(("(", ")")))
def qry_02_whole(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").unionByName(corpus.contracts(spark, d).select("doc_id", "text"))
    return docs.select("doc_id", search.widened(F.col("text")).alias("widened"))


query("QRY-02", ORACLES["QRY-02-whole"])(qry_02_whole)


#: yes/no answers derived from the contracts: whole, without or with an empty field, no JSON, empty, not an object, null
_RAW = """CASE WHEN doc_id % 7 = 0 THEN concat('{"answer":"Ano","fullContext":"', regexp_extract(text, '[0-9]{6}/[0-9]{4}', 0), '"}') WHEN doc_id % 7 = 1 THEN '{"answer":"Ne"}'
    WHEN doc_id % 7 = 2 THEN '{"answer":"","fullContext":"x"}' WHEN doc_id % 7 = 3 THEN '{"answer":"Ano","fullContext":' WHEN doc_id % 7 = 4 THEN '' WHEN doc_id % 7 = 5 THEN '["Ano"]' END"""


@query("JSON-03-whole", with_contracts(f"""r AS (SELECT doc_id, {_RAW} AS raw FROM contracts), p AS (SELECT *, CASE WHEN json_valid(raw) AND starts_with(raw, '{{') THEN raw END AS j FROM r),
    g AS (SELECT *, json_extract_string(j, '$.answer') AS a, json_extract_string(j, '$.fullContext') AS c FROM p)
    SELECT doc_id, CASE WHEN a <> '' AND c <> '' THEN a ELSE raw END AS answer, CASE WHEN a <> '' AND c <> '' THEN c END AS full_context FROM g"""))
def json_03_whole(spark, d):
    rows = corpus.contracts(spark, d).select("doc_id", answers.yes_no(F.expr(_RAW)).alias("got"))
    return rows.select("doc_id", "got.answer", F.col("got.fullContext").alias("full_context"))


query("JSON-03", ORACLES["JSON-03-whole"])(json_03_whole)


# -- fuzzy words -------------------------------------------------------------------------------------------------------
_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(strip_accents(query)), '[a-z0-9]+')) AS word FROM " + _Q
_TOKENS = "SELECT doc_id, unnest(regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+')) AS token FROM contracts"


@query("DOC-01", with_contracts(f"""w AS ({_WORDS}), t AS (SELECT DISTINCT doc_id, token FROM ({_TOKENS})), k AS (SELECT DISTINCT token FROM t),
    s AS (SELECT word, token, round(0.7 * jaro_winkler_similarity(word, token) + 0.3 * (1 - levenshtein(word, token) / greatest(length(word), length(token))), 6) AS score FROM w, k),
    r AS (SELECT doc_id, word, token, score, CAST(row_number() OVER (PARTITION BY doc_id, word ORDER BY score DESC, token) AS INTEGER) AS rank FROM t JOIN s USING (token) WHERE score >= 0.6) SELECT * FROM r WHERE rank <= 10"""))
def doc_01(spark, d):
    return fuzzy.nearest_tokens(corpus.contracts(spark, d), questions(spark))
