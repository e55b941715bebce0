"""Registered queries of requests, places, result tables and files, each beside its SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import answers, audit, extract, locate, report, requests, results, trigrams
from factloom.operators import patterns as P
from factloom.plans.queries import _ANS, _BIRTH, _EXPORT, _EXT, _FLAT, _POSITIONAL, _STAT_SQL, _TABLE, _VERIFIED, LOG_SQL, ROWS_SQL, VALUES_SQL, _asked, _log, _places, _rows, _sql, _table, _values, query
from factloom.sources import corpus, files, streams
from factloom.sources.corpus import with_contracts

_EDGE = "' ' || chr(9) || chr(10) || chr(13)"

# -- files: written to the shared folder and read again ----------------------------------------------------------------


@query("SRC-01", with_contracts("c AS (SELECT doc_id % 64 AS file, string_agg(text, chr(10) || chr(10) ORDER BY doc_id) AS text FROM contracts GROUP BY 1) SELECT * FROM c"))
def src_01(spark, d):
    path = files.new_path(spark, "contracts")
    texts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    rows = corpus.contracts(spark, d).groupBy((F.col("doc_id") % 64).alias("file")).agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n").alias("text"))
    rows.write.partitionBy("file").text(path)
    back = files.contract_files(spark, f"{path}/*/*.txt")  # the writer ends each text with a line feed
    return back.select(F.regexp_extract("path", "file=([0-9]+)", 1).cast("long").alias("file"), F.regexp_replace("text", r"\n\z", "").alias("text"))


@query("SRC-04", with_contracts(f"{_ANS} SELECT doc_id, chunk_id, coalesce(nullif(raw_text, ''), 'Nenalezeno') AS answer FROM llm"))
def src_04(spark, d):
    path = files.new_path(spark, "answers")
    corpus.answers(spark, d).write.json(path)
    return files.model_answers(spark, path).select("doc_id", "chunk_id", results.answer_text(F.col("raw_text")).alias("answer"))


_CSV = f"SELECT CAST(ord AS STRING) AS category, 'a \"quoted\", part' AS query, type AS label, value, value AS absolute_value, 'text' AS type FROM ({ROWS_SQL})"


@query("SNK-01", f"SELECT category, query, nullif(label, '') AS label, nullif(value, '') AS value, nullif(absolute_value, '') AS absolute_value, type FROM ({_CSV})")
def snk_01(spark, d):
    path = files.new_path(spark, "csv")
    report.write_csv(_sql(spark, d, _CSV, "events"), path)
    return report.read_csv(spark, path)


@query("SNK-02", f"SELECT 'csv' AS format, count(*) AS records, 'data' AS part, true AS dated FROM ({ROWS_SQL})")
def snk_02(spark, d):
    path = files.new_path(spark, "csv")
    report.write_csv(_sql(spark, d, _CSV, "events"), path)
    return report.manifest(spark, path).select("format", "records", F.explode("parts").alias("part"), F.col("generated").rlike("^20[0-9-]+T[0-9:.]+").alias("dated"))


def _long(sheet: str, item: str, n: str, text: str) -> str:
    return f"SELECT '{sheet}' AS sheet, {item} AS item, round(CAST({n} AS DOUBLE), 6) AS n, {text} AS text"


_AS_ROWS = ("mean_confidence", "sd_confidence", "distinct_values", "distinct_types", "min_start", "max_start", "mean_start", "matches", "mean_matches", "max_matches")


@query("SNK-03", f"""WITH rows AS ({ROWS_SQL}), t AS (SELECT *, coalesce(nullif(type, ''), 'unknown') AS kind FROM rows), s AS (SELECT kind, value, row_number() OVER (PARTITION BY kind ORDER BY ord) AS k FROM t WHERE value <> ''), st AS ({_STAT_SQL}),
    v AS (SELECT {_EXPORT} AS kind, ord FROM rows), top AS (SELECT kind, count(*) AS n FROM v GROUP BY 1 ORDER BY n DESC, min(ord) LIMIT 5)
    {_long("results", "CAST(ord AS VARCHAR)", "confidence", "coalesce(type, '~') || '|' || value")} FROM rows UNION ALL {_long("summary", "'types ' || kind", "count(*)", "NULL")} FROM t GROUP BY kind UNION ALL {_long("summary", "'value types ' || kind", "n", "NULL")} FROM top
    UNION ALL {_long("summary", "'confidence avg_confidence'", "avg(confidence * 100)", "NULL")} FROM rows UNION ALL {_long("summary", "'confidence min_confidence'", "min(confidence * 100)", "NULL")} FROM rows UNION ALL {_long("summary", "'confidence max_confidence'", "max(confidence * 100)", "NULL")} FROM rows
    UNION ALL {_long("types", "t.kind", "any_value(c)", "any_value(x)")} FROM (SELECT kind, count(*) AS c FROM t GROUP BY 1) t JOIN (SELECT kind, string_agg(value, '; ' ORDER BY k) AS x FROM s WHERE k <= 5 GROUP BY kind) y ON y.kind = t.kind GROUP BY t.kind
    UNION ALL """ + " UNION ALL ".join(_long("statistics", f"'{c}'", c, "NULL") + " FROM st" for c in _AS_ROWS))
def snk_03(spark, d):
    path = files.new_path(spark, "workbook")
    report.write_workbook(_rows(spark, d), path, ["ord"])
    sheets = report.read_workbook(spark, path)
    none = F.lit(None).cast("string")
    as_rows = lambda sheet, item, n, text: sheets[sheet].select(F.lit(sheet).alias("sheet"), item.alias("item"), F.round(n.cast("double"), 6).alias("n"), text.alias("text"))
    stats = sheets["statistics"].select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("n")) for c in _AS_ROWS])).alias("x"))
    out = as_rows("results", F.col("ord").cast("string"), F.col("confidence"), F.concat(F.coalesce("type", F.lit("~")), F.lit("|"), "value"))
    out = out.unionByName(as_rows("summary", F.concat_ws(" ", "section", "item"), F.col("value"), none)).unionByName(as_rows("types", F.col("type"), F.col("n"), F.col("samples")))
    return out.unionByName(stats.select(F.lit("statistics").alias("sheet"), "x.item", F.round("x.n", 6).alias("n"), none.alias("text")))


@query("AGG-06-sketches", f"SELECT count(DISTINCT nullif(value, '')) AS distinct_values, count(DISTINCT type) AS distinct_types, true AS near FROM ({ROWS_SQL})")
def agg_06_sketches(spark, d):
    """Days' sketches are stored, merged and held against the exact counts: near if both are within three standard errors."""
    rows = _rows(spark, d)
    days = files.stored(report.distinct_sketches(rows, F.floor(F.col("ord") / 1000), ["value", "type"]), "sketches")
    about, exact = report.merged_sketches(days, ["value", "type"]).first(), report.statistics(rows).select("distinct_values")
    counts = rows.agg(F.count_distinct("type").alias("distinct_types")).join(exact)  # one row each
    near = [F.abs(F.lit(a) - F.col(c)) <= 0.03 * F.col(c) for a, c in ((about["value"], "distinct_values"), (about["type"], "distinct_types"))]
    return counts.select("distinct_values", "distinct_types", (near[0] & near[1]).alias("near"))


@query("FLT-01-indexed", f"SELECT ord, type, value FROM ({ROWS_SQL}) WHERE coalesce(contains(lower(type), '12 kč'), false) OR coalesce(contains(lower(value), '12 kč'), false)")
def flt_01_indexed(spark, d):
    path = files.new_path(spark, "indexed")
    trigrams.write_indexed(trigrams.dealt(_rows(spark, d), "ord"), path, ["type", "value"])
    return trigrams.search(spark, path, ["type", "value"], "12 Kč").select("ord", "type", "value")


@query("SRC-01-stream", with_contracts(f"m AS ({_places(_EXT[0][1], 0, 0)}) SELECT doc_id, value AS original_value, CAST(s AS INTEGER) AS start_pos FROM m WHERE {_BIRTH}"))
def src_01_stream(spark, d):
    """Contracts come as files in two parts; a stream extracts from the first, stops, and goes on with the second."""
    path, out, at = (files.new_path(spark, name) for name in ("incoming", "extracted", "stream"))
    given = corpus.contracts(spark, d).select(F.to_json(F.struct("doc_id", F.lit(0).alias("chunk_id"), F.col("text").alias("raw_text"))).alias("value"), (F.col("doc_id") % 2).alias("half"))
    for half in (0, 1):
        given.where(F.col("half") == half).select("value").write.mode("append").text(path)
        found = extract.mentions(streams.model_answers(spark, path).select("doc_id", F.col("raw_text").alias("text")), ["birthNumber"])
        streams.appended(found.select("doc_id", "original_value", F.col("start").alias("start_pos")), out, at).awaitTermination()
    return spark.read.parquet(out)


@query("SNK-05", f"SELECT event_id, level, category, data FROM ({LOG_SQL})")
def snk_05(spark, d):
    path = files.new_path(spark, "audit")
    log = _log(spark, d)
    audit.write_json(log, path)
    return spark.read.schema(log.schema).json(path).select("event_id", "level", "category", "data")


# -- categories and requests -------------------------------------------------------------------------------------------
_RAW_CATEGORIES = """SELECT o_orderkey AS query_set, CASE WHEN o_orderkey % 7 = 0 THEN 'not json' ELSE concat('[{"category":"', o_orderpriority, '","items":["zákazník ', CAST(o_custkey AS STRING), '","stav ', o_orderstatus,
    '"]},{"category":"Stav","items":["stav ', o_orderstatus, '"]}]') END AS raw_text FROM orders"""
_SETS = "SELECT o_orderkey AS query_set, CAST(0 AS INTEGER) AS ord, concat('zákazník ', CAST(o_custkey AS STRING)) AS query FROM orders UNION ALL SELECT o_orderkey, CAST(1 AS INTEGER), concat('stav ', o_orderstatus) FROM orders"


@query("SRC-03", f"""WITH j AS (SELECT query_set, unnest(from_json(raw_text, '[{{"category":"VARCHAR","items":["VARCHAR"]}}]')) AS c FROM ({_RAW_CATEGORIES}) WHERE json_valid(raw_text))
    SELECT query_set, unnest(c.items) AS query, c.category AS category FROM j UNION ALL SELECT query_set, query, 'Ostatní' FROM ({_SETS}) WHERE query_set % 7 = 0""")
def src_03(spark, d):
    raw, asked = _sql(spark, d, _RAW_CATEGORIES, "orders"), _sql(spark, d, _SETS, "orders")
    return results.categories(raw, asked).select("query_set", "query", "category")


_ASKED = r"""SELECT conv_id AS query_set, turn * 100000 + i AS ord, q[i] AS query FROM (SELECT conv_id, turn, q, unnest(range(1, len(q) + 1)) AS i FROM (SELECT conv_id, turn,
    list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: length(x) > 0) AS q FROM conversations))"""
_FIRST = f"SELECT query_set, query, min(ord) AS ord FROM ({_ASKED}) GROUP BY 1, 2"
_CHUNKED = f"SELECT *, CAST((n - 1) // 5 AS INTEGER) AS chunk_id, CAST((n - 1) % 5 AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_set ORDER BY ord) AS n FROM ({_FIRST}))"
_LISTED = f"SELECT query_set, chunk_id, string_agg(CAST(place + 1 AS VARCHAR) || '. ' || query, chr(10) ORDER BY place) AS listed FROM ({_CHUNKED}) GROUP BY 1, 2"


def _lines(spark, d):
    from factloom.operators.search import query_list

    rows = query_list(_table(spark, d, "conversations").withColumn("k", F.struct("conv_id", "turn")), "k", "text")
    return rows.select(F.col("k.conv_id").alias("query_set"), (F.col("k.turn") * 100000 + F.col("ord") + 1).alias("ord"), "query")


@query("REQ-01", _FIRST)
def req_01(spark, d):
    return requests.distinct_queries(_lines(spark, d))


@query("REQ-02", f"SELECT query_set, query, ord, chunk_id, place FROM ({_CHUNKED})")
def req_02(spark, d):
    return requests.chunks(requests.distinct_queries(_lines(spark, d)))


@query("REQ-03", _LISTED)
def req_03(spark, d):
    return requests.numbered(requests.chunks(requests.distinct_queries(_lines(spark, d))))


@query("REQ-04", rf"""WITH x AS (SELECT doc_id, trim(regexp_replace(regexp_replace(replace(strip_accents(text), chr(9), ' '), ' +', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_EDGE}) AS document FROM documents)
    SELECT doc_id, chunk_id, 'Dokument:' || chr(10) || document || chr(10) || chr(10) || 'Dotazy:' || chr(10) || listed AS prompt FROM x JOIN ({_LISTED}) ON query_set = doc_id""")
def req_04(spark, d):
    lists = requests.numbered(requests.chunks(requests.distinct_queries(_lines(spark, d))))
    parts = requests.request_parts(_table(spark, d, "documents").select("doc_id", "text", F.col("doc_id").alias("query_set")), lists)
    return requests.rendered(files.stored(parts, "requests"))


@query("REQ-05", f"SELECT conv_id, turn, CASE WHEN trim(c.text, {_EDGE}) = '' OR c.text IS NULL THEN 'query' WHEN trim(d.text, {_EDGE}) = '' OR d.text IS NULL THEN 'document' END AS refused FROM conversations c LEFT JOIN documents d ON doc_id = conv_id")
def req_05(spark, d):
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("conv_id"), F.col("text").alias("document"))
    return _table(spark, d, "conversations").join(docs, "conv_id", "left").select("conv_id", "turn", requests.refusal(F.col("text"), F.col("document")).alias("refused"))


_SYNONYMS = "(VALUES " + ", ".join(f"('{w}', '{s}')" for w, ss in P.SYNONYMS.items() for s in ss) + ") AS y(word, synonym)"


@query("DOC-02", with_contracts(rf"w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+')) AS word FROM contracts) SELECT doc_id AS query_id, word, synonym FROM w JOIN {_SYNONYMS} USING (word)"))
def doc_02(spark, d):
    asked = corpus.contracts(spark, d).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return requests.expanded(asked, P.SYNONYMS)


# -- answers and result tables -----------------------------------------------------------------------------------------
@query("JOI-04", with_contracts(f"""{_ANS}, {_FLAT}, a AS (SELECT doc_id, 0 AS ord, 'rodné číslo' AS query FROM llm UNION ALL SELECT doc_id, 1, 'všechny identifikátory' FROM llm),
    v AS (SELECT doc_id, query, max(CASE WHEN label = 'Datum' OR label IS NULL THEN value END) AS value FROM flat GROUP BY 1, 2)
    SELECT doc_id, CAST(ord AS INTEGER) AS ord, query, coalesce(nullif(value, ''), 'Nenalezeno') AS value FROM a LEFT JOIN v USING (doc_id, query)"""))
def joi_04(spark, d):
    llm = corpus.answers(spark, d)
    return answers.completed_one_each(answers.flatten(llm).withColumnRenamed("item", "pos"), _asked(llm))


_ORIGINS = f"SELECT *, CASE WHEN ord % 4 = 0 THEN 'api' WHEN ord % 4 = 1 THEN 'batch' WHEN ord % 4 = 2 THEN 'local' END AS origin, ord % 8 = 1 AS failed FROM ({ROWS_SQL})"


@query("JSON-07", f"SELECT ord, CASE WHEN origin = 'api' THEN 0.95 WHEN origin = 'batch' AND failed THEN 0 WHEN origin = 'batch' THEN 0.95 ELSE coalesce(nullif(confidence, 0), 0.9) END::DOUBLE AS confidence FROM ({_ORIGINS})")
def json_07(spark, d):
    return results.with_confidence(_sql(spark, d, _ORIGINS, "events"), "origin", "failed").select("ord", "confidence")


@query("JSON-08", with_contracts(f"{_ANS}, {_FLAT} SELECT doc_id, query, nullif(label, '') AS label, value, CASE WHEN query = 'rodné číslo' THEN 'Osoby' ELSE 'Ostatní' END AS category, 0.95::DOUBLE AS confidence FROM flat"))
def json_08(spark, d):
    mapping = spark.sql("SELECT * FROM VALUES ('rodné číslo', 0, 'Čísla'), ('rodné číslo', 1, 'Osoby') AS t(query, ord, category)")
    return results.history(answers.flatten(corpus.answers(spark, d)), mapping).select("doc_id", "query", "label", "value", "category", "confidence")


@query("JSON-10", with_contracts(f"""{_ANS}, {_FLAT} SELECT doc_id, r.query AS query, CASE WHEN len(r.values) > 0 THEN array_to_string(list_transform(r.values, lambda x: x.value), '|') ELSE coalesce(r.value, '') END AS marked FROM j"""))
def json_10(spark, d):
    raw = F.when(F.try_parse_json("raw_text").isNotNull(), F.from_json("raw_text", answers.BATCH)["results"])
    rows = corpus.answers(spark, d).select("doc_id", F.explode(raw).alias("r"))
    marked = results.to_highlight(F.lit(None).cast("string"), F.col("r.values.value"), F.col("r.value"))
    return rows.select("doc_id", "r.query", F.array_join(marked, "|").alias("marked"))


#: several marks a row; the later rows have none
_FEEDBACK = "SELECT CAST(floor(event_id / 4) AS BIGINT) AS ord, ts, event_type AS status FROM events"


@query("JOI-06", f"SELECT ord, value, status FROM ({ROWS_SQL}) r LEFT JOIN (SELECT ord, max({{'ts': ts, 'status': status}}).status AS status FROM ({_FEEDBACK}) GROUP BY ord) f USING (ord)")
def joi_06(spark, d):
    return results.with_status(_rows(spark, d), _sql(spark, d, _FEEDBACK, "events"), "ord").select("ord", "value", "status")


def _items(spark, d):
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hist_id"), F.col("l_linenumber").alias("item_idx"), F.col("l_quantity").alias("quantity"))


@query("JOI-07", "SELECT l_orderkey AS hist_id, l_linenumber AS item_idx, l_quantity AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity = 50)")
def joi_07(spark, d):
    rows = _items(spark, d)
    return results.without_history(rows, rows.where("quantity = 50"))


@query("JOI-08", "SELECT l_orderkey AS hist_id, l_linenumber AS item_idx, l_quantity AS quantity FROM lineitem WHERE (l_orderkey, l_linenumber) IN (SELECT (l_orderkey, l_linenumber) FROM lineitem WHERE l_quantity = 50)")
def joi_08(spark, d):
    rows = _items(spark, d)
    return results.only_selected(rows, rows.where("quantity = 50"), ["hist_id", "item_idx"])


@query("SRT-01", f"SELECT ord, type, value, row_number() OVER (ORDER BY type NULLS FIRST, ord) AS position FROM ({ROWS_SQL})")
def srt_01(spark, d):
    return results.sorted_by(_rows(spark, d), "type", "ord").select("ord", "type", "value", "position")


@query("FLT-03", f"SELECT event_id, category, row_number() OVER (ORDER BY ts DESC, event_id) AS position FROM ({LOG_SQL})")
def flt_03(spark, d):
    return results.newest_first(_log(spark, d), "ts", "event_id").select("event_id", "category", "position")


@query("LOG-03", f"SELECT id, value, trim(value) AS found, CAST(length(value) AS INTEGER) AS told_length, CAST(length(trim(value)) AS INTEGER) AS found_length FROM ({VALUES_SQL}) WHERE value IS DISTINCT FROM trim(value)")
def log_03(spark, d):
    return audit.mismatches(_values(spark, d).withColumn("found", F.trim("value")), "value", "found")


@query("DOC-03", with_contracts(f"""{_ANS}, {_FLAT}, f AS (SELECT DISTINCT doc_id, value FROM flat WHERE query = 'rodné číslo'), t AS (SELECT DISTINCT doc_id, value FROM ({_places(_EXT[0][1], 0, 0)}) WHERE {_BIRTH}),
    n AS (SELECT (SELECT count(*) FROM f JOIN t USING (doc_id, value)) AS hits, (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM t) AS wanted)
    SELECT *, round(hits / found, 9) AS precision, round(hits / wanted, 9) AS recall, round(2 * hits / (found + wanted), 9) AS f1 FROM n"""))
def doc_03(spark, d):
    found = answers.flatten(corpus.answers(spark, d)).where(F.col("query") == "rodné číslo")
    truth = extract.mentions(corpus.contracts(spark, d), ["birthNumber"]).select("doc_id", F.lit("rodné číslo").alias("query"), "value")
    out = results.quality(found, truth)
    return out.select("hits", "found", "wanted", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


# -- places ------------------------------------------------------------------------------------------------------------
def _mapped(spark, d):
    return locate.with_offset_map(corpus.contracts(spark, d).select("doc_id", "text"))


#: the only marks in contracts are those of one bold phrase: places after its first and second mark are two and four further on
_MAP = """p AS (SELECT doc_id, text, instr(text, '**Kupní cena**') - 1 AS b, length(text) - CASE WHEN contains(text, '**Kupní cena**') THEN 4 ELSE 0 END AS n FROM contracts),
    map AS (SELECT doc_id, list_transform(range(n), lambda i: CAST(CASE WHEN b < 0 OR i < b THEN i WHEN i < b + 10 THEN i + 2 ELSE i + 4 END AS INTEGER)) AS index_map FROM p)"""


@query("NRM-04", with_contracts(f"{_MAP} SELECT doc_id, index_map FROM map"))
def nrm_04(spark, d):
    return _mapped(spark, d).select("doc_id", locate.index_map(F.col("offset_map")).alias("index_map"))


@query("NRM-05", with_contracts(f"{_MAP}, u AS (SELECT doc_id, unnest(range(len(index_map))) AS i, index_map FROM map) SELECT doc_id, index_map[i + 1] AS original, list(CAST(i AS INTEGER) ORDER BY i) AS normalized FROM u GROUP BY 1, 2"))
def nrm_05(spark, d):
    return locate.reverse_map(_mapped(spark, d))


@query("NRM-04-runs", with_contracts("p AS (SELECT doc_id, instr(text, '**Kupní cena**') - 1 AS b FROM contracts) SELECT doc_id, r AS normal, r + k AS original FROM (SELECT doc_id, unnest(CASE WHEN b < 0 THEN [0] ELSE [0, b, b + 10] END)::INTEGER AS r, unnest(CASE WHEN b < 0 THEN [0] ELSE [0, 2, 4] END)::INTEGER AS k FROM p)"))
def nrm_04_runs(spark, d):
    return _mapped(spark, d).select("doc_id", F.explode("offset_map.runs").alias("r")).select("doc_id", "r.normal", "r.original")


#: every number of the normalised text, mapped back
_NUMBERS = rf"""{_MAP}, n AS (SELECT doc_id, b, index_map, lower(strip_accents(replace(text, '**', ''))) AS text FROM p JOIN map USING (doc_id)),
    g AS (SELECT doc_id, b, v[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i-1], lambda x: length(x))), 0) AS s FROM (SELECT doc_id, b, v, g, unnest(range(1, len(v) + 1)) AS i
    FROM (SELECT doc_id, b, regexp_extract_all(text, '[0-9]+') AS v, string_split_regex(text, '[0-9]+') AS g FROM n))),
    e AS (SELECT doc_id, value, b, s, s + length(value) - 1 AS last FROM g)
    SELECT doc_id, value, CAST(s + CASE WHEN b < 0 OR s < b THEN 0 WHEN s < b + 10 THEN 2 ELSE 4 END AS INTEGER) AS start_pos, CAST(last + 1 + CASE WHEN b < 0 OR last < b THEN 0 WHEN last < b + 10 THEN 2 ELSE 4 END AS INTEGER) AS end_pos FROM e"""


@query("NRM-06", with_contracts(_NUMBERS))
def nrm_06(spark, d):
    normal = _mapped(spark, d).select("doc_id", "offset_map", F.col("normal").alias("text"))
    rows = extract.placed(normal, [("number", 0, "[0-9]+")], "doc_id", "offset_map")
    place = locate.original_range(F.col("start"), F.col("end"), F.col("offset_map"))
    return rows.select("doc_id", "value", place.alias("p")).select("doc_id", "value", F.col("p.start").alias("start_pos"), F.col("p.end").alias("end_pos"))


#: all values of the answers, of any type, in the normalised text
_SOUGHT = rf"""{_ANS}, {_FLAT}, {_MAP}, t AS (SELECT doc_id, b, lower(strip_accents(replace(text, '**', ''))) AS normal FROM p), v AS (SELECT DISTINCT doc_id, value FROM flat WHERE value <> ''),
    o AS (SELECT doc_id, value, b, normal, lower(trim(strip_accents(value))) AS needle FROM v JOIN t USING (doc_id)),
    s AS (SELECT doc_id, value, b, needle, unnest(list_filter(range(length(normal)), lambda i: substr(normal, i + 1, length(needle)) = needle)) AS s FROM o WHERE contains(normal, needle)),
    e AS (SELECT *, s + length(needle) - 1 AS last FROM s), m AS (SELECT doc_id, value, CAST(s + CASE WHEN b < 0 OR s < b THEN 0 WHEN s < b + 10 THEN 2 ELSE 4 END AS INTEGER) AS start_pos,
    CAST(last + 1 + CASE WHEN b < 0 OR last < b THEN 0 WHEN last < b + 10 THEN 2 ELSE 4 END AS INTEGER) AS end_pos FROM e)"""


@query("JOI-09-all", with_contracts(f"{_SOUGHT} SELECT * FROM m"))
def joi_09_all(spark, d):
    rows = answers.flatten(corpus.answers(spark, d)).select("doc_id", "value", F.lit("text").alias("type"))
    found = locate.value_places(rows, corpus.contracts(spark, d))
    return found.select("doc_id", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("LOG-05", with_contracts(f"""{_SOUGHT}, c AS (SELECT doc_id, value, count(*) AS match_count FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, query ORDER BY label NULLS FIRST, value) AS n FROM flat)
    SELECT r.doc_id, query AS query_id, count(*) OVER (PARTITION BY r.doc_id, query) AS result_count, label, value, coalesce(match_count, 0) AS match_count FROM r LEFT JOIN c USING (doc_id, value)"""))
def log_05(spark, d):
    rows = answers.flatten(corpus.answers(spark, d)).withColumnRenamed("query", "query_id")
    places = locate.value_places(rows.select("doc_id", "value", F.lit("text").alias("type")), corpus.contracts(spark, d))
    return audit.search_results(rows, places.select("doc_id", "value", "start")).select("doc_id", "query_id", "result_count", "label", "value", "match_count")


@query("JOI-09", with_contracts(f"{_ANS}, {_FLAT}, m AS ({_places(r'[0-9]{6}/[0-9]{4}', 0, 0)}) SELECT DISTINCT m.doc_id, m.value, CAST(s AS INTEGER) AS start_pos, CAST(s + 11 AS INTEGER) AS end_pos FROM m JOIN flat f ON f.doc_id = m.doc_id AND f.value = m.value"))
def joi_09(spark, d):
    rows = answers.flatten(corpus.answers(spark, d)).where(F.col("query") == "rodné číslo")
    found = locate.value_places(rows.select("doc_id", "value", V.value_type(F.col("value")).alias("type")), corpus.contracts(spark, d))
    return found.select("doc_id", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


_SUM = r"(?i)[0-9]{1,3}(?:[\s.,][0-9]{3})*(?:[.,][0-9]{1,2})?\s*(?:Kč|CZK|EUR|€|USD|\$)?"
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, '{k}' AS kind, {i} AS k, unnest(regexp_extract_all(raw_text, '{r}')) AS v FROM llm"
    for i, (k, r) in enumerate((("birthNumber", r"[0-9]{6}/[0-9]{3,4}"), ("name", rf"{P.UP}{P.LOW}+\s+{P.UP}{P.LOW}+"), ("amount", _SUM), ("percentage", r"[0-9]{1,3}(?:[.,][0-9]{1,2})?\s*%"), ("account", r"[0-9]{2,10}/[0-9]{4}")))
)


@query("EXT-20", with_contracts(rf"""{_ANS}, p AS (SELECT doc_id, kind, k, CASE WHEN kind = 'amount' THEN trim(regexp_replace(v, '\s+', ' ', 'g')) ELSE v END AS v FROM ({_FOUND})),
    b AS (SELECT doc_id, text, kind, k, v, instr(lower(text), lower(v)) AS s, CASE WHEN kind = 'amount' THEN instr(lower(text), lower(trim(regexp_replace(v, '(?i)\s*(Kč|CZK|EUR|€|USD|\$)\s*$', '')))) ELSE 0 END AS bs FROM p JOIN contracts USING (doc_id)),
    s AS (SELECT doc_id, kind, k, text, CASE WHEN s > 0 THEN s ELSE bs END - 1 AS s, CASE WHEN s > 0 THEN length(v) ELSE length(regexp_extract(substr(text, bs), '{_SUM.replace("(?i)", "(?i)^")}')) END AS n FROM b WHERE s > 0 OR bs > 0)
    SELECT doc_id, CAST(s AS INTEGER) AS start_pos, CAST(s + n AS INTEGER) AS end_pos, min_by(kind, k) AS kind, any_value(substr(text, s + 1, n)) AS found FROM s GROUP BY 1, 2, 3"""))
def ext_20(spark, d):
    found = locate.individual_values(corpus.answers(spark, d).select("doc_id", F.col("raw_text").alias("answer")), corpus.contracts(spark, d))
    return found.select("doc_id", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "kind", F.col("text").alias("found"))


# -- parsing, completing and placing answers ---------------------------------------------------------------------------
_SINGLE = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN concat(chr(10), '  {"type":"single","value":"', CAST(o_custkey AS STRING), '"} ', chr(9)) WHEN o_orderkey % 17 = 0 THEN concat('  ', chr(10)) WHEN o_orderkey % 7 = 0 THEN ' prostý text' WHEN o_orderkey % 11 = 0 THEN '' ELSE concat('{"type":"single","value":"', CAST(o_custkey AS STRING), '"}') END AS raw_text FROM orders"""


@query("JSON-01", f"SELECT id, 'single' AS type, CASE WHEN json_valid(raw_text) THEN json_extract_string(raw_text, '$.value') ELSE coalesce(nullif(raw_text, ''), 'Nenalezeno') END AS value FROM (SELECT id, trim(raw_text, {_EDGE}) AS raw_text FROM ({_SINGLE}))")
def json_01(spark, d):
    return _sql(spark, d, _SINGLE, "orders").select("id", answers.single(F.col("raw_text")).alias("a")).select("id", "a.type", "a.value")


@query("JSON-02", with_contracts(f"{_ANS} SELECT doc_id, q.query AS query, 'Nenalezeno' AS value FROM llm, (VALUES ('rodné číslo'), ('všechny identifikátory')) AS q(query) WHERE NOT json_valid(raw_text)"))
def json_02(spark, d):
    bad = corpus.answers(spark, d).where(F.try_parse_json("raw_text").isNull())
    return answers.completed(answers.flatten(bad), _asked(bad)).select("doc_id", "query", "value")


@query("JSON-04", with_contracts(f"""{_POSITIONAL}, {_VERIFIED} SELECT doc_id, CAST(i - 1 AS INTEGER) AS item, r[i].label AS label, r[i].value AS value, r[i].start AS start_pos, r[i]."end" AS end_pos, r[i].confidence AS confidence, r[i].type AS type FROM i"""))
def json_04(spark, d):
    rows = corpus.answers(spark, d, positional=True).select("doc_id", F.posexplode(answers.placed(F.col("raw_text"))["results"]).alias("item", "r"))
    return rows.select("doc_id", "item", "r.label", "r.value", F.col("r.start").alias("start_pos"), F.col("r.end").alias("end_pos"), "r.confidence", "r.type")


#: history items with a single answer, several results, none, an answer of another type, or only a value or content of their own
_HISTORY = """SELECT event_id AS hist_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN event_type END AS category, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('dotaz ', CAST(user_id AS STRING)) END AS query,
    CASE WHEN event_id % 6 = 0 THEN concat('{"type":"single","value":"', CAST(user_id AS STRING), CASE WHEN event_id % 4 = 0 THEN ' Kč","label":"Cena"}' ELSE ' a b","label":""}' END)
    WHEN event_id % 6 = 1 THEN concat('{"type":"multiple","results":[{"label":"A","value":"', CAST(user_id AS STRING), '"},{"value":""}]}')
    WHEN event_id % 6 = 2 THEN CASE WHEN event_id % 4 = 0 THEN '{"type":"multiple","results":[]}' ELSE '{"type":"multiple","value":"x"}' END
    WHEN event_id % 6 = 3 THEN '{"type":"jiný","value":"x"}' END AS answer,
    CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 < 3 THEN concat(CAST(user_id AS STRING), ',50 Kč') END AS value, CASE WHEN event_id % 7 > 0 THEN concat('obsah ', event_type) END AS content, CASE WHEN event_id % 8 < 4 THEN 'Popis' END AS label FROM events"""


@query("JSON-09", f"""WITH h AS ({_HISTORY}), p AS (SELECT *, json_extract_string(answer, '$.type') AS kind FROM h),
    i AS (SELECT hist_id, category, query, 0 AS item_idx, json_extract_string(answer, '$.label') AS label, json_extract_string(answer, '$.value') AS value FROM p WHERE kind = 'single'
    UNION ALL SELECT hist_id, category, query, k, json_extract_string(answer, '$.results[' || k || '].label'), json_extract_string(answer, '$.results[' || k || '].value') FROM (SELECT *, unnest(range(json_array_length(answer, '$.results')::BIGINT)) AS k FROM p WHERE kind = 'multiple')
    UNION ALL SELECT hist_id, category, query, 0, label, CASE WHEN value IS NULL THEN content ELSE value END FROM p WHERE answer IS NULL),
    r AS (SELECT hist_id, CAST(item_idx AS INTEGER) AS item_idx, coalesce(category, '') AS category, coalesce(nullif(query, ''), 'Dotaz') AS query, coalesce(nullif(label, ''), 'Výsledek') AS label, coalesce(value, '') AS value FROM i)
    SELECT *, {_TABLE} AS type, CASE WHEN {_TABLE} = 'number' THEN regexp_replace(value, '[^0-9]', '', 'g') ELSE '' END AS absolute_value FROM r""")
def json_09(spark, d):
    rows = _sql(spark, d, _HISTORY, "events")
    return answers.table_rows(rows.withColumn("answer", F.from_json("answer", answers.ANSWER)))


@query("JOI-02", with_contracts(f"{_ANS}, {_FLAT} SELECT doc_id, query, CASE WHEN query = 'rodné číslo' THEN 'Osoby' ELSE 'Ostatní' END AS category FROM flat"))
def joi_02(spark, d):
    mapping = spark.sql("SELECT * FROM VALUES ('rodné číslo', 0, 'Čísla'), ('rodné číslo', 1, 'Osoby') AS t(query, ord, category)")
    return answers.with_category(answers.flatten(corpus.answers(spark, d)), mapping).select("doc_id", "query", "category")


@query("JOI-05", with_contracts(f"{_POSITIONAL}, {_VERIFIED} SELECT doc_id, value, start_pos, end_pos FROM verified"))
def joi_05(spark, d):
    rows = corpus.answers(spark, d, positional=True).select("doc_id", F.posexplode(answers.placed(F.col("raw_text"))["results"]).alias("item", "r"))
    return answers.verified(rows, corpus.contracts(spark, d)).select("doc_id", "value", F.col("start").alias("start_pos"), F.col("end").alias("end_pos"))


@query("JOI-10", with_contracts(f"""{_ANS}, {_FLAT}, v AS (SELECT doc_id, value FROM flat UNION ALL SELECT doc_id, ' KUPNÍ cena ' FROM contracts), p AS (SELECT doc_id, value, instr(text, trim(value)) AS a, instr(lower(text), lower(trim(value))) AS b FROM v JOIN contracts USING (doc_id))
    SELECT doc_id, value, CAST(CASE WHEN a > 0 THEN a - 1 WHEN b > 0 THEN b - 1 END AS INTEGER) AS place FROM p"""))
def joi_10(spark, d):
    docs = corpus.contracts(spark, d)
    values = answers.flatten(corpus.answers(spark, d)).select("doc_id", "value").unionByName(docs.select("doc_id", F.lit(" KUPNÍ cena ").alias("value")))
    return values.join(docs, "doc_id").select("doc_id", "value", answers.right_place(F.col("text"), F.col("value")).alias("place"))
