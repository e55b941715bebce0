"""The registered queries of the library's own operators, each beside its SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import textnorm as N
from factloom.functions import values as V
from factloom.operators import answers, audit, extract, highlight, report, search
from factloom.operators import patterns as P
from factloom.sources import corpus
from factloom.sources.corpus import with_contracts
from factloom.sources.files import dealt

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return dealt(df) if name == "documents" else df


def _sql(spark: SparkSession, d: str, sql: str, table: str) -> DataFrame:
    return corpus._from(spark, sql, table, _table(spark, d, table))


# -- normalisation -----------------------------------------------------------------------------------------------------
_MD = "text"
for _p, _to in ((r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"_([^_]+)_", r"\1"), (r"~~([^~]+)~~", r"\1"), (r"`([^`]+)`", r"\1"),
                (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*[0-9]+\.\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1")):
    _MD = f"regexp_replace({_MD}, '{_p}', '{_to}', 'g')"


@query("NRM-01", "SELECT doc_id, strip_accents(text) AS plain FROM documents")
def nrm_01(spark, d):
    return _table(spark, d, "documents").select("doc_id", N.remove_diacritics(F.col("text")).alias("plain"))


@query("NRM-02", f"SELECT doc_id, {_MD} AS bare FROM documents")
def nrm_02(spark, d):
    return _table(spark, d, "documents").select("doc_id", N.remove_markdown(F.col("text")).alias("bare"))


@query("NRM-03", f"SELECT doc_id, lower(strip_accents({_MD})) AS normalized FROM documents")
def nrm_03(spark, d):
    return _table(spark, d, "documents").select("doc_id", N.normalized(F.col("text")).alias("normalized"))


@query("NRM-07", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(strip_accents(text), chr(9), ' '), ' +', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS prepared FROM documents""")
def nrm_07(spark, d):
    return _table(spark, d, "documents").select("doc_id", N.normalized_for_model(F.col("text")).alias("prepared"))


@query("NRM-08", "SELECT doc_id, CAST(length(text) AS INTEGER) AS characters, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines FROM documents")
def nrm_08(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.length("text").alias("characters"), F.size(F.split("text", "\n", -1)).alias("lines"))


@query("NRM-09", f"SELECT doc_id, round((1 - length(lower(strip_accents({_MD}))) / length(text)) * 100) AS saved FROM documents")
def nrm_09(spark, d):
    return _table(spark, d, "documents").select("doc_id", N.reduction(F.col("text"), N.normalized(F.col("text"))).alias("saved"))


# -- values ------------------------------------------------------------------------------------------------------------
VALUES_SQL = """SELECT o_orderkey AS id, CASE CAST(o_orderkey % 14 AS INTEGER)
    WHEN 0 THEN concat(lpad(CAST(40 + o_custkey % 60 AS STRING), 2, '0'), lpad(CAST(1 + o_custkey % 80 AS STRING), 2, '0'), lpad(CAST(1 + o_custkey % 35 AS STRING), 2, '0'), '/', CAST(1000 + o_orderkey % 9000 AS STRING))
    WHEN 1 THEN concat('cz', CAST(10 + o_orderkey % 90 AS STRING), ' 0800 ', CAST(1000 + o_custkey % 9000 AS STRING))
    WHEN 2 THEN concat(CAST(o_custkey % 1000000 AS STRING), '-', CAST(10000000 + o_orderkey AS STRING), '/0800')
    WHEN 3 THEN concat(CAST(1 + o_custkey % 99 AS STRING), ',', CAST(10 + o_orderkey % 90 AS STRING), ' %')
    WHEN 4 THEN concat(CAST(1 + o_custkey % 31 AS STRING), '.', CAST(1 + o_orderkey % 12 AS STRING), '.2024')
    WHEN 5 THEN concat(CAST(1 + o_custkey % 999 AS STRING), ' ', CAST(100 + o_orderkey % 900 AS STRING), '  Kč')
    WHEN 6 THEN CAST(10000000 + o_orderkey AS STRING)
    WHEN 7 THEN CASE WHEN o_custkey % 2 = 0 THEN ' Jan Novak ' ELSE concat('940919-', CAST(1000 + o_orderkey % 9000 AS STRING)) END WHEN 8 THEN '' WHEN 9 THEN concat('+420 777 ', CAST(100 + o_orderkey % 900 AS STRING), ' 456')
    WHEN 10 THEN '2024-01-31' WHEN 11 THEN concat(CAST(o_custkey AS STRING), '/', CAST(o_orderkey % 90 AS STRING))
    WHEN 12 THEN concat('7.850.', CAST(100 + o_orderkey % 900 AS STRING), ',- Kč') ELSE concat(CAST(o_custkey AS STRING), ',50 EUR') END AS value FROM orders"""
_NS, _ONE = r"regexp_replace(value, '\s+', '', 'g')", r"trim(regexp_replace(value, '\s+', ' ', 'g'))"
_CHECKS = {
    "VAL-01": (V.is_birth_number, rf"regexp_matches({_NS}, '^[0-9]{{6}}/[0-9]{{3,4}}$')"),
    "VAL-02": (V.is_iban, rf"regexp_matches(upper({_NS}), '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{1,30}}$')"),
    "VAL-03": (V.is_bank_account, rf"regexp_matches({_NS}, '^([0-9]{{0,6}}-)?[0-9]{{2,10}}/[0-9]{{4}}$')"),
    "VAL-04": (V.is_amount, rf"regexp_matches({_ONE}, '(?i)^[0-9]{{1,3}}([ ,.][0-9]{{3}})*([.,][0-9]{{1,2}})?\s*(Kč|CZK|EUR|€|USD|\$)?$')"),
    "VAL-05": (V.is_rpsn, rf"regexp_matches(regexp_replace({_NS}, ',', '.'), '^[0-9]{{1,3}}(\.[0-9]{{1,2}})?%?$')"),
    "VAL-06": (V.is_date, r"(regexp_matches(trim(value), '^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}$') OR regexp_matches(trim(value), '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'))"),
}
_BIRTH = r"""(regexp_matches(regexp_replace(value, '[^0-9]', '', 'g'), '^[0-9]{9,10}$') AND coalesce((CASE WHEN TRY_CAST(substr(regexp_replace(value, '[^0-9]', '', 'g'), 3, 2) AS INT) > 50 THEN TRY_CAST(substr(regexp_replace(value, '[^0-9]', '', 'g'), 3, 2) AS INT) - 50
    ELSE TRY_CAST(substr(regexp_replace(value, '[^0-9]', '', 'g'), 3, 2) AS INT) END) BETWEEN 1 AND 12 AND TRY_CAST(substr(regexp_replace(value, '[^0-9]', '', 'g'), 5, 2) AS INT) BETWEEN 1 AND 31, false))"""
_SUM = " + ".join(f"TRY_CAST(substr(value, {i + 1}, 1) AS INT) * {8 - i}" for i in range(7))
_CHECKS |= {
    "VAL-09": (V.plausible_birth_number, _BIRTH),
    "VAL-10": (V.valid_company_id, f"(regexp_matches(value, '^[0-9]{{8}}$') AND coalesce((CASE WHEN ({_SUM}) % 11 < 2 THEN ({_SUM}) % 11 ELSE 11 - ({_SUM}) % 11 END) = TRY_CAST(substr(value, 8, 1) AS INT), false))"),
}
_KIND = "CASE WHEN value = '' THEN 'unknown' " + " ".join(f"WHEN {_CHECKS[k][1]} THEN '{n}'" for k, n in (("VAL-01", "birthNumber"), ("VAL-02", "iban"), ("VAL-03", "bankAccount"), ("VAL-05", "rpsn"), ("VAL-06", "date"), ("VAL-04", "amount"))) + " ELSE 'text' END"
_TABLE = r"CASE WHEN value <> '' AND regexp_matches(trim(value), '^[0-9\s.,+\-/]+\s*[A-Za-zčČ]*\.?-?$') THEN 'number' ELSE 'text' END"
_EXPORT = r"""CASE WHEN value = '' THEN 'empty' WHEN regexp_matches(value, '^[0-9]{6}/[0-9]{3,4}$') THEN 'birthNumber' WHEN regexp_matches(value, '(?i)^[0-9]+(?:[.,][0-9]+)?\s*(?:Kč|CZK|€|EUR)$') THEN 'currency'
    WHEN regexp_matches(value, '^(\+420\s?)?[0-9]{3}\s?[0-9]{3}\s?[0-9]{3}$') THEN 'phone' WHEN regexp_matches(value, '^[A-Z][a-z]+\s+[A-Z][a-z]+$') THEN 'name' WHEN regexp_matches(value, '^[0-9]+$') THEN 'number' WHEN regexp_matches(value, '^[0-9]+/[0-9]+$') THEN 'fraction' ELSE 'text' END"""
_NORMAL = rf"""CASE WHEN value = '' THEN '' WHEN kind = 'birthNumber' THEN regexp_replace({_NS}, '([0-9]{{6}})([0-9]{{3,4}})', '\1/\2') WHEN kind = 'iban' THEN upper({_NS}) WHEN kind = 'bankAccount' THEN {_NS}
    WHEN kind = 'amount' THEN {_ONE} WHEN kind = 'rpsn' THEN regexp_replace({_NS}, ',', '.') WHEN kind = 'date' THEN trim(value) ELSE lower(trim(value)) END"""


def _values(spark, d):
    return _sql(spark, d, VALUES_SQL, "orders")


for _name, (_f, _s) in _CHECKS.items():
    query(_name, f"SELECT id, {_s} AS valid FROM ({VALUES_SQL})")(lambda spark, d, f=_f: _values(spark, d).select("id", f(F.col("value")).alias("valid")))
for _name, _f, _s in (("VAL-08", V.value_type, _KIND), ("VAL-11", V.table_type, _TABLE), ("VAL-13", V.export_type, _EXPORT)):
    query(_name, f"SELECT id, {_s} AS kind FROM ({VALUES_SQL})")(lambda spark, d, f=_f: _values(spark, d).select("id", f(F.col("value")).alias("kind")))


@query("VAL-07", f"SELECT id, {_NORMAL} AS normal FROM (SELECT *, {_KIND} AS kind FROM ({VALUES_SQL}))")
def val_07(spark, d):
    return _values(spark, d).select("id", V.normalize_value(F.col("value"), V.value_type(F.col("value"))).alias("normal"))


@query("VAL-12", f"SELECT id, CASE WHEN {_TABLE} = 'number' THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE '' END AS digits FROM ({VALUES_SQL})")
def val_12(spark, d):
    return _values(spark, d).select("id", V.absolute_value(F.col("value"), V.table_type(F.col("value"))).alias("digits"))


# -- extraction --------------------------------------------------------------------------------------------------------
_U, _L = "[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ]", "[a-záčďéěíňóřšťúůýž]"
_LS = "[a-záčďéěíňóřšťúůýž\\s]"
_M = r"\d{1,3}(?:[\s.,]\d{3})*(?:[,.]\d{1,2})?\s*"
_V = "value"
_NSV = r"regexp_replace(value, '\s+', '', 'g')"
_DIG = "regexp_replace(value, '[^0-9]', '', 'g')"
_D = lambda i: rf"regexp_extract(value, '(\d{{1,2}})\.\s*(\d{{1,2}})\.\s*(\d{{4}})', {i})"
#: (RE2 pattern, validity, normal form)
_EXT = [
    ("birthNumber", r"\b\d{6}\s*/\s*\d{3,4}\b", _BIRTH, _NSV),
    ("fullName", rf"\b{_U}{_L}+\s+{_U}{_L}+(?:\s+{_U}{_L}+)?\b", rf"regexp_matches(value, '^{_U}{_L}+(\s+{_U}{_L}+){{1,3}}$')", _V),
    ("address", rf"\b{_U}{_LS}+\s+\d+(?:/\d+)?[a-zA-Z]?,\s*\d{{3}}\s*\d{{2}}\s+{_U}{_LS}+", rf"regexp_matches(value, '\d{{3}}\s*\d{{2}}') AND regexp_matches(value, '{_U}{_L}')", _V),
    ("phoneNumber", r"(?:\+420\s?)?(?:\d{3}\s?\d{3}\s?\d{3}|\d{9})\b", f"(length({_DIG}) = 9 OR length({_DIG}) = 12 AND starts_with({_DIG}, '420'))", f"CASE WHEN starts_with({_DIG}, '420') THEN '+420 ' || substr({_DIG}, 4) ELSE {_DIG} END"),
    ("amount", rf"(?i)\b{_M}(?:Kč|CZK|korun|EUR|€)\b", "true", "regexp_replace(regexp_replace(value, '[^0-9,.]', '', 'g'), ',', '.') || ' ' || regexp_extract(value, '(?i)(Kč|CZK|korun|EUR|€)', 1)"),
    ("bankAccount", r"\b(?:CZ\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}|\d{1,10}[-/]\d{4})\b", "true", _NSV),
    ("parcelNumber", None, None, None),
    ("buildingNumber", r"(?i)\bč\.p\.\s*\d+(?:/\d+)?|\bčíslo\s*popisné\s*\d+(?:/\d+)?", "true", r"regexp_extract(value, '\d+(?:/\d+)?')"),
    ("czechDate", r"\b\d{1,2}\.\s*\d{1,2}\.\s*\d{4}\b", f"CAST({_D(1)} AS INT) BETWEEN 1 AND 31 AND CAST({_D(2)} AS INT) BETWEEN 1 AND 12 AND CAST({_D(3)} AS INT) BETWEEN 1900 AND 2100", f"lpad({_D(1)}, 2, '0') || '.' || lpad({_D(2)}, 2, '0') || '.' || {_D(3)}"),
    ("contractNumber", r"(?i)\b(?:smlouva|kontrakt)\s*(?:č\.|číslo)\s*[\w/-]+|\bspis\.?\s*zn\.?\s*[\w/-]+", "true", r"regexp_extract(value, '[\w/-]+$')"),
    ("companyId", r"(?i)\bIČO?\s*:?\s*\d{8}\b|\bidentifikační\s*číslo\s*:?\s*\d{8}\b", _CHECKS["VAL-10"][1].replace("value", r"regexp_extract(value, '\d{8}')"), r"regexp_extract(value, '\d{8}')"),
    ("vatNumber", r"(?i)\bDIČ\s*:?\s*CZ\d{8,10}\b", r"regexp_matches(value, 'CZ\d{8,10}')", r"regexp_extract(value, 'CZ\d{8,10}')"),
]
_COLS = ["doc_id", "pattern", "label", "value", "original_value", "start_pos", "end_pos"]


def _places(regex: str, no: int, group: int) -> str:
    """One row for each match: the value, its group and its 0-based place."""
    return rf"""SELECT doc_id, {no} AS pattern_no, v[i] AS value, p[i] AS part, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS s
        FROM (SELECT doc_id, v, g, p, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{regex}') AS v, string_split_regex(text, '{regex}') AS g, regexp_extract_all(text, '{regex}', {group}) AS p FROM contracts))"""


def _mentions(spark, d, name):
    m = extract.mentions(corpus.contracts(spark, d), [name])
    return m.select("doc_id", "pattern", "label", "value", "original_value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


for _i, (_name, _re, _ok, _norm) in enumerate(_EXT):
    _label = P.PATTERNS[_i].label if P.PATTERNS[_i].type == _name else P.DEFAULT_LABEL
    if _re is None:  # no look-ahead in RE2: the text that follows is tested by place
        _s = rf"""SELECT doc_id, 'parcelNumber' AS pattern, 'Parcelní číslo' AS label, value, value AS original_value, CAST(s AS INTEGER) AS start_pos, CAST(s + length(value) AS INTEGER) AS end_pos
            FROM ({_places(r"\b\d+/\d+\b", 0, 0)}) JOIN contracts USING (doc_id) WHERE NOT regexp_matches(substr(text, CAST(s AS BIGINT) + length(value) + 1), '^\s*\d{{3}}') AND NOT {_BIRTH}"""
    else:
        _s = f"SELECT doc_id, '{_name}' AS pattern, '{_label}' AS label, {_norm} AS value, value AS original_value, CAST(s AS INTEGER) AS start_pos, CAST(s + length(value) AS INTEGER) AS end_pos FROM ({_places(_re, 0, 0)}) WHERE {_ok}"
    query(f"EXT-{_i + 1:02}", with_contracts(f"m AS ({_s}) SELECT * FROM m"))(lambda spark, d, n=_name: _mentions(spark, d, n))
_G, _PR, _DD = r"[\s\w]*?", rf"({_M}(?:Kč|CZK|korun))", r"(\d{1,2}[\.\s]\d{1,2}[\.\s]\d{4})"
_PA = f"({_U}{_LS}+)"
_CLAUSES = [
    [rf"kupní\s+cena{_G}činí{_G}{_PR}", rf"za\s+cenu{_G}{_PR}", rf"celková\s+cena{_G}{_PR}"],
    [rf"splatnost{_G}{_DD}", rf"do{_G}(\d+)\s*(?:dnů|dní)", rf"nejpozději{_G}{_DD}"],
    [r"parcela\s+č\.\s*(\d+/\d+)", r"pozemek\s+parcelní\s+číslo\s*(\d+/\d+)", r"stavba\s+na\s+parcele\s*(\d+/\d+)"],
    [rf"prodávající:\s*{_PA}", rf"kupující:\s*{_PA}", rf"nájemce:\s*{_PA}"],
]
for _i, ((_name, _label, _), _res) in enumerate(zip(P.CLAUSES, _CLAUSES, strict=True)):
    _all = " UNION ALL ".join(_places("(?i)" + r, no, 1) for no, r in enumerate(_res))
    _s = rf"SELECT doc_id, '{_name}' AS pattern, '{_label}' AS label, regexp_replace(regexp_replace(part, '^\s+', ''), '\s+$', '') AS value, value AS original_value, CAST(s AS INTEGER) AS start_pos, CAST(s + length(value) AS INTEGER) AS end_pos FROM ({_all})"
    query(f"EXT-{_i + 13}", with_contracts(f"m AS ({_s}) SELECT * FROM m"))(lambda spark, d, n=_name: _mentions(spark, d, n))


# -- queries -----------------------------------------------------------------------------------------------------------
#: Fixed: questions of the kind that users ask.
QUESTIONS = ["Najdi rodné číslo prodávajícího", "Jaké je RČ kupujícího", "Ukaž všechna rodná čísla", "Jaká je kupní cena", "Kolik činí záloha", "Najdi všechny částky v Kč", "Jaká je RPSN", "Najdi úrokovou sazbu",
             "Ukaž všechny procentuální hodnoty", "Číslo účtu prodávajícího", "Najdi IBAN", "Ukaž bankovní spojení", "Kdy byla podepsána smlouva", "Termín splatnosti", "Najdi všechna data v dokumentu", "Jaké je parcelní číslo",
             "Najdi číslo parcely", "Kdo je prodávající", "Jméno kupujícího", "Seznam všech osob", "dvě  mezery"]
_Q = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in enumerate(QUESTIONS)) + ") AS t(query_id, query)"
#: conversations' lines as queries
_LINES = r"SELECT DISTINCT trim(l, ' ' || chr(9) || chr(13)) AS query FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM conversations) WHERE length(trim(l, ' ' || chr(9) || chr(13))) > 0"


def questions(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_Q}")


_RULES = " ".join(f"WHEN rule = {i} THEN regexp_matches(folded, '{r}')" for i, (r, _) in enumerate(P.INTENTS))
_NAMES = "(VALUES " + ", ".join(f"({i}, {j}, '{n}')" for i, (_, ns) in enumerate(P.INTENTS) for j, n in enumerate(ns)) + ") AS n(rule, j, pattern)"
_ALL = "(VALUES " + ", ".join(f"({i}, '{s.name}')" for i, s in enumerate(P.PATTERNS)) + ") AS a(j, pattern)"


def _intent_sql(source: str) -> str:
    return f"""q AS (SELECT query_id, query, lower(strip_accents(query)) AS folded FROM {source}), hit AS (SELECT query_id, pattern, rule, j FROM q, {_NAMES} WHERE CASE {_RULES} END),
    intents AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rule, j) - 1 AS INTEGER) AS intent_ord, pattern FROM hit
    UNION ALL SELECT query_id, CAST(j AS INTEGER), a.pattern FROM q, {_ALL} WHERE query_id NOT IN (SELECT query_id FROM hit))"""


_INTENT_SQL = _intent_sql(_Q)
#: the lines of all conversations and contracts as queries, each known by its text
_ASKED_LINES = f"""(SELECT query AS query_id, query FROM ({_LINES}) UNION SELECT text, text FROM contracts) AS t"""


@query("QRY-01", with_contracts(f"{_intent_sql(_ASKED_LINES)} SELECT query_id AS query, intent_ord, pattern FROM intents"))
def qry_01(spark, d):
    lines = search.query_list(_table(spark, d, "conversations"), "conv_id", "text").select("query").unionByName(corpus.contracts(spark, d).select(F.col("text").alias("query")))
    return search.intents(lines.distinct().withColumn("query_id", F.col("query"))).select("query", "intent_ord", "pattern")


@query("SRC-02", r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 0) AS q FROM conversations)
    SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS ord, q[i] AS query, len(q) > 5 AS batch_mode FROM (SELECT *, unnest(range(1, len(q) + 1)) AS i FROM s)""")
def src_02(spark, d):
    rows = _table(spark, d, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    return search.query_list(rows, "k", "text").select("k.conv_id", "k.turn", "ord", "query", "batch_mode")


def _answer(spark, d):
    asked = search.intents(questions(spark))
    return search.answer(extract.mentions(corpus.contracts(spark, d), folded=True), asked, lie=True)


@query("WIN-03")
def win_03(spark, d):
    return _answer(spark, d).select("doc_id", "query_id", "rank", "pattern", "label", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), F.round("confidence", 6).alias("confidence"), F.round("relevance", 6).alias("relevance"))


@query("WIN-04")
def win_04(spark, d):
    found = search.deduplicated(extract.mentions(corpus.contracts(spark, d), folded=True), search.intents(questions(spark)), lie=True)
    return search.summary(found, corpus.contracts(spark, d), questions(spark)).select("doc_id", "query_id", "n", F.round("confidence", 6).alias("confidence"))


# -- model answers -----------------------------------------------------------------------------------------------------
_ANS = f"llm AS ({corpus.answers_sql()})"
_FLAT = """j AS (SELECT doc_id, chunk_id, unnest(from_json(raw_text, '{"results":[{"query":"VARCHAR","type":"VARCHAR","value":"VARCHAR","values":[{"label":"VARCHAR","value":"VARCHAR"}]}]}').results) AS r FROM llm WHERE json_valid(raw_text)),
    flat AS (SELECT doc_id, chunk_id, r.query AS query, NULL AS label, coalesce(nullif(r.value, ''), 'Nenalezeno') AS value FROM j WHERE NOT (r.type = 'multiple' AND r.values IS NOT NULL)
    UNION ALL SELECT doc_id, chunk_id, query, v.label, v.value FROM (SELECT doc_id, chunk_id, r.query AS query, unnest(r.values) AS v FROM j WHERE r.type = 'multiple'))"""
_ASK = "asked AS (SELECT doc_id, q.query FROM llm, (VALUES ('rodné číslo'), ('všechny identifikátory')) AS q(query))"


def _asked(llm):
    return llm.select("doc_id", F.posexplode(F.array(F.lit("rodné číslo"), F.lit("všechny identifikátory"))).alias("ord", "query"))


@query("JSON-05", with_contracts(f"{_ANS}, {_FLAT} SELECT doc_id, query, label, value FROM flat"))
def json_05(spark, d):
    return answers.flatten(corpus.answers(spark, d)).select("doc_id", "query", "label", "value")


@query("JOI-03", with_contracts(f"{_ANS}, {_FLAT}, {_ASK} SELECT doc_id, query, label, value FROM flat UNION ALL SELECT doc_id, query, NULL, 'Nenalezeno' FROM (SELECT DISTINCT doc_id, query FROM asked) a WHERE NOT EXISTS (SELECT 1 FROM flat f WHERE f.doc_id = a.doc_id AND f.query = a.query)"))
def joi_03(spark, d):
    llm = corpus.answers(spark, d)
    return answers.completed(answers.flatten(llm), _asked(llm))


_POSITIONAL = f"pos AS ({corpus.positional_sql()})"
#: results within the text; those whose span holds another text are sought elsewhere
_VERIFIED = r"""i AS (SELECT doc_id, unnest(range(1, len(r) + 1)) AS i, r FROM (SELECT doc_id, from_json(regexp_extract(raw_text, '\{.*\}'), '{"results":[{"label":"VARCHAR","value":"VARCHAR","start":"INTEGER","end":"INTEGER","confidence":"DOUBLE","type":"VARCHAR"}]}').results AS r FROM pos WHERE contains(raw_text, '{'))),
    v AS (SELECT doc_id, text, CAST(i - 1 AS INTEGER) AS item, r[i].label AS label, r[i].value AS value, r[i].start AS s, r[i]."end" AS e, r[i].confidence AS c, r[i].type AS type FROM i JOIN contracts USING (doc_id)),
    w AS (SELECT *, trim(substr(text, s + 1, e - s)) = trim(value) AS same, coalesce(nullif(instr(text, trim(value)), 0), nullif(instr(lower(text), lower(trim(value))), 0)) - 1 AS place FROM v WHERE value <> '' AND s >= 0 AND s < e AND e <= length(text)),
    verified AS (SELECT doc_id, item, label, CASE WHEN same THEN value ELSE substr(text, place + 1, length(trim(value))) END AS value, CAST(CASE WHEN same THEN s ELSE place END AS INTEGER) AS start_pos,
    CAST(CASE WHEN same THEN e ELSE place + length(trim(value)) END AS INTEGER) AS end_pos, round(CASE WHEN same THEN c ELSE greatest(0.5, coalesce(nullif(c, 0), 0.8) - 0.2) END, 9) AS confidence, type FROM w WHERE same OR place IS NOT NULL)"""


@query("JSON-06", with_contracts(f"{_POSITIONAL}, {_VERIFIED} SELECT * FROM verified"))
def json_06(spark, d):
    placed = answers.placed(F.col("raw_text"))["results"]
    rows = corpus.answers(spark, d, positional=True).select("doc_id", F.posexplode(placed).alias("item", "r"))
    return answers.verified(rows, corpus.contracts(spark, d)).withColumnsRenamed({"start": "start_pos", "end": "end_pos"}).withColumn("confidence", F.round("confidence", 9))


# -- reports -----------------------------------------------------------------------------------------------------------
ROWS_SQL = """SELECT event_id AS ord, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS type, CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 5 = 0 THEN concat(CAST(user_id AS STRING), ' Kč') ELSE CAST(user_id AS STRING) END AS value,
    CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, CAST(event_id % 1000 AS INTEGER) AS start_position, CAST(1 + event_id % 3 AS INTEGER) AS match_count FROM events"""


def _rows(spark, d):
    return _sql(spark, d, ROWS_SQL, "events")


@query("AGG-01", f"SELECT coalesce(nullif(type, ''), 'unknown') AS type, count(*) AS n FROM ({ROWS_SQL}) GROUP BY 1")
def agg_01(spark, d):
    return report.type_counts(_rows(spark, d))


@query("AGG-02", f"SELECT round(avg(confidence * 100), 6) AS avg_confidence, round(min(confidence * 100), 6) AS min_confidence, round(max(confidence * 100), 6) AS max_confidence FROM ({ROWS_SQL})")
def agg_02(spark, d):
    out = report.confidence_summary(_rows(spark, d))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("AGG-03", f"WITH k AS (SELECT {_EXPORT} AS value_type, ord FROM ({ROWS_SQL})) SELECT value_type, count(*) AS n FROM k GROUP BY 1 ORDER BY n DESC, min(ord) LIMIT 5")
def agg_03(spark, d):
    return report.top_value_types(_rows(spark, d), F.col("ord"))


@query("AGG-04", f"""WITH r AS (SELECT coalesce(nullif(type, ''), 'unknown') AS type, value, confidence, ord FROM ({ROWS_SQL})), s AS (SELECT type, value, row_number() OVER (PARTITION BY type ORDER BY ord) AS n FROM r WHERE value <> '')
    SELECT r.type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, any_value(x.samples) AS samples FROM r JOIN (SELECT type, string_agg(value, '; ' ORDER BY n) AS samples FROM s WHERE n <= 5 GROUP BY type) x ON x.type = r.type GROUP BY r.type""")
def agg_04(spark, d):
    return report.types_with_samples(_rows(spark, d), ["ord"]).select("type", "n", F.round("avg_confidence", 6).alias("avg_confidence"), "samples")


@query("AGG-05", f"""WITH r AS (SELECT coalesce(nullif(type, ''), 'unknown') AS type, value, ord FROM ({ROWS_SQL})), s AS (SELECT type, value, row_number() OVER (PARTITION BY type ORDER BY ord) AS n FROM r WHERE value <> '')
    SELECT r.type, round(count(*) / (SELECT count(*) FROM r) * 100, 1) AS percent, any_value(x.samples) AS sample_text FROM r JOIN (SELECT type, string_agg(value, '; ' ORDER BY n) AS samples FROM s WHERE n <= 3 GROUP BY type) x ON x.type = r.type GROUP BY r.type""")
def agg_05(spark, d):
    return report.types_with_samples(_rows(spark, d), ["ord"]).select("type", "percent", "sample_text")


_STAT = {"AGG-06": ["distinct_values", "distinct_types"], "AGG-07": ["mean_confidence", "sd_confidence"], "AGG-08": ["min_start", "max_start", "mean_start"], "AGG-09": ["matches", "mean_matches", "max_matches"]}
_STAT_SQL = f"""SELECT count(DISTINCT nullif(value, '')) AS distinct_values, count(DISTINCT type) + max(CASE WHEN type IS NULL THEN 1 ELSE 0 END) AS distinct_types, round(avg(confidence), 6) AS mean_confidence, round(stddev_pop(confidence), 6) AS sd_confidence,
    min(start_position) AS min_start, max(start_position) AS max_start, round(avg(start_position), 6) AS mean_start, CAST(sum(match_count) AS BIGINT) AS matches, round(avg(match_count), 6) AS mean_matches, max(match_count) AS max_matches FROM ({ROWS_SQL})"""
for _name, _cols in _STAT.items():

    @query(_name, f"SELECT {', '.join(_cols)} FROM ({_STAT_SQL})")
    def _stat(spark, d, cols=tuple(_cols)):
        out = report.statistics(_rows(spark, d))
        return out.select(*[F.round(c, 6).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c) for c in cols])


@query("AGG-10", "SELECT source AS category, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT NULL, count(*) FROM documents")
def agg_10(spark, d):
    return report.per_category(_table(spark, d, "documents").withColumnRenamed("source", "category"))


@query("FLT-01", f"SELECT ord, type, value FROM ({ROWS_SQL}) WHERE coalesce(contains(lower(type), '12'), false) OR coalesce(contains(lower(value), '12'), false)")
def flt_01(spark, d):
    return report.containing(_rows(spark, d), ["type", "value"], "12").select("ord", "type", "value")


@query("SNK-04", "SELECT doc_id, concat(substr(text, 1, 20), CASE WHEN length(text) > 20 THEN '...' ELSE '' END) AS cut FROM documents")
def snk_04(spark, d):
    return _table(spark, d, "documents").select("doc_id", report.cut(F.col("text"), 20).alias("cut"))


# -- highlighting ------------------------------------------------------------------------------------------------------
MARKED = ["the", "then", "tion"]
_HIT = " UNION ALL ".join(f"""SELECT doc_id, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + (i - 1) * {len(v)} AS INTEGER) AS s, '{v}' AS value, {o} AS o FROM (SELECT doc_id, g, unnest(range(1, len(g))) AS i FROM (SELECT doc_id, string_split(strip_accents(lower(text)), '{v}') AS g FROM documents))""" for o, v in enumerate(MARKED))


@query("HIL-01", f"SELECT doc_id, s AS start_pos, CAST(s + length(value) AS INTEGER) AS end_pos, value FROM ({_HIT})")
def hil_01(spark, d):
    return highlight.occurrences(_table(spark, d, "documents"), MARKED).select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "value")


#: the words of the benchmark items, as a table of values; each is sought in all documents
_VALUES = "SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS value FROM benchmark"


@query("HIL-01-table", f"""WITH v AS (SELECT value FROM ({_VALUES}) WHERE length(value) > 2), t AS (SELECT doc_id, strip_accents(lower(text)) AS t FROM documents),
    g AS (SELECT doc_id, value, string_split(t, value) AS g FROM t JOIN v ON contains(t, value)), s AS (SELECT doc_id, value, list_transform(g, lambda x: length(x) + length(value)) AS n, unnest(range(1, len(g))) AS i FROM g)
    SELECT doc_id, value, CAST(list_sum(n[1:i]) - length(value) AS INTEGER) AS start_pos FROM s""")
def hil_01_table(spark, d):
    words = _table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("value")).distinct().where(F.length("value") > 2)
    found = highlight.occurrences_of(_table(spark, d, "documents"), words.withColumn("value_ord", F.lit(0)))
    return found.select("doc_id", "value", F.col("start").alias("start_pos"))


@query("HIL-04", f"SELECT doc_id, value, count(*) AS n FROM ({_HIT}) GROUP BY doc_id, value")
def hil_04(spark, d):
    return highlight.occurrences(_table(spark, d, "documents"), MARKED).groupBy("doc_id", "value").agg(F.count("*").alias("n"))


@query("HIL-02", f"""WITH h AS (SELECT doc_id, s, CAST(s + length(value) AS INTEGER) AS e, o FROM ({_HIT})), b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM h),
    i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, o ROWS UNBOUNDED PRECEDING) AS island FROM b) SELECT doc_id, min(s) AS start_pos, max(e) AS end_pos FROM i GROUP BY doc_id, island""")
def hil_02(spark, d):
    docs = _table(spark, d, "documents")
    return highlight.merged(highlight.occurrences(docs, MARKED), docs).select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


_ISLANDS = f"""h AS (SELECT doc_id, s, CAST(s + length(value) AS INTEGER) AS e, o FROM ({_HIT})), b AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM h),
    i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s >= pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s, o ROWS UNBOUNDED PRECEDING) AS island FROM b), m AS (SELECT doc_id, min(s) AS s, max(e) AS e FROM i GROUP BY doc_id, island)"""


@query("HIL-03", f"""WITH {_ISLANDS}, g AS (SELECT doc_id, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS s, s AS e FROM m), t AS (SELECT doc_id, coalesce(max(e), 0) AS s, any_value(length(text)) AS e FROM documents LEFT JOIN m USING (doc_id) GROUP BY doc_id),
    x AS (SELECT doc_id, s, e, 'highlight' AS kind FROM m UNION ALL SELECT doc_id, s, e, 'text' FROM g UNION ALL SELECT doc_id, s, e, 'text' FROM t)
    SELECT doc_id, CAST(s AS INTEGER) AS seg_start, kind, substr(text, s + 1, e - s) AS content FROM x JOIN documents USING (doc_id) WHERE e > s""")
def hil_03(spark, d):
    docs = _table(spark, d, "documents")
    return highlight.segments(highlight.merged(highlight.occurrences(docs, MARKED), docs), docs)


# -- audit log ---------------------------------------------------------------------------------------------------------
LOG_SQL = "SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 3 ELSE 1 END AS level, event_type AS category, value * 10 AS duration, props AS data FROM events"


def _log(spark, d):
    return _sql(spark, d, LOG_SQL, "events")


@query("LOG-01", f"SELECT event_id, level, category FROM ({LOG_SQL}) WHERE level >= 3")
def log_01(spark, d):
    return audit.filtered(_log(spark, d), audit.ERROR).select("event_id", "level", "category")


@query("LOG-02", f"SELECT category, CASE WHEN duration > 1000 THEN 2 ELSE 0 END AS level, count(*) AS n, max(duration) AS longest FROM ({LOG_SQL}) GROUP BY 1, 2")
def log_02(spark, d):
    return audit.slow(_log(spark, d))


_VALIDATORS = [f"VAL-{i:02}" for i in range(1, 7)]


@query("LOG-04", " UNION ALL ".join(f"SELECT id, '{k}' AS kind, CASE WHEN {_CHECKS[k][1]} THEN 0 ELSE 2 END AS level FROM ({VALUES_SQL})" for k in _VALIDATORS))
def log_04(spark, d):
    """Each value against each validator."""
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), _CHECKS[k][0](F.col("value")).alias("ok")) for k in _VALIDATORS]))
    return audit.validations(_values(spark, d).select("id", told.alias("x")).select("id", "x.*"), "ok").select("id", "kind", "level")


@query("TOP-01", f"SELECT event_id, category FROM ({LOG_SQL}) ORDER BY ts DESC, event_id LIMIT 1000")
def top_01(spark, d):
    return audit.newest(_log(spark, d), [F.col("ts").desc(), "event_id"]).select("event_id", "category")
