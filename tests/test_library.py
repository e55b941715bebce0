"""Oracle runs of all registered queries, and properties and hand-made cases of the operators."""

import random
import re
import time
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from factloom import cluster
from factloom.functions import textnorm as N
from factloom.functions import values as V
from factloom.operators import answers, audit, extract, fuzzy, highlight, locate, report, requests, results, search, trigrams
from factloom.plans import queries as plans
from factloom.sources import corpus, files, streams

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, duck, name):
    got = plans.QUERIES[name](spark, D)
    cols = sorted(got.columns)
    want = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    assert plain(map(tuple, got.select(*cols).collect())) == plain([tuple(r[names.index(c)] for c in cols) for r in want.fetchall()])


def test_spans_hold_their_values(spark):
    docs = corpus.contracts(spark, D)
    rows = extract.mentions(docs).join(docs, "doc_id")
    assert rows.where(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")) != F.col("original_value")).count() == 0


def test_at_most_ten_answers_and_a_summary_row_for_each_pair(spark):
    found = plans.QUERIES["WIN-03"](spark, D)
    assert found.groupBy("doc_id", "query_id").count().agg(F.max("count")).first()[0] <= 10
    assert plans.QUERIES["WIN-04"](spark, D).count() == corpus.contracts(spark, D).count() * len(plans.QUESTIONS)


def column(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(f(F.col("v"))).collect()]


def test_value_rules(spark):
    assert column(spark, V.value_type, ["123456/0800", "12", "7 850 000 Kč", "", "7850000", "31.12.2024", None]) == ["birthNumber", "rpsn", "amount", "unknown", "text", "date", "unknown"]
    assert column(spark, V.plausible_birth_number, ["940919/1022", "941319/1022", "945219/1022"]) == [True, False, True]
    assert column(spark, lambda c: V.absolute_value(c, V.table_type(c)), ["12,50 Kč", "5,9%", "7.850.000,- Kč"]) == ["1250", "", "7850000"]
    assert column(spark, N.remove_diacritics, ["příliš žluťoučký kůň"]) == ["prilis zlutoucky kun"]
    assert column(spark, N.remove_markdown, ["* a\n* b", "**x** _y_ [z](u)"]) == [" a\n b", "x y z"]


def test_model_answers(spark):
    raw = ['{"type":"single","value":"x"}', " plain\n", "", None, '\n {"type":"single","value":" x"}\u00a0', " \t"]
    assert column(spark, lambda c: answers.single(c)["value"], raw) == ["x", "plain", "Nenalezeno", "Nenalezeno", " x", "Nenalezeno"]
    placed = plans.QUERIES["JSON-06"](spark, D)
    text = corpus.contracts(spark, D)
    bad = placed.join(text, "doc_id").where(F.substring("text", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")) != F.col("value"))
    assert bad.count() == 0 and placed.where("value = 'ABSENT'").count() == 0 and placed.count() > 0
    asked = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, ord int, query string")
    given = spark.createDataFrame([(1, 0, 0, "a", "x"), (1, 0, 1, "a", "y"), (1, 0, 2, "c", "z")], "doc_id long, chunk_id int, pos int, query string, value string")
    assert sorted(map(tuple, answers.completed_one_each(given, asked).collect())) == [(1, 0, "a", "y"), (1, 1, "b", "Nenalezeno")]


def test_table_rows_and_categories(spark):
    schema = f"hist_id long, category string, query string, answer {answers.ANSWER}, value string, content string, label string"
    history = spark.createDataFrame(
        [
            (1, "c", "q", ("single", "5 Kč", "l", None), None, None, None), (2, None, "", ("multiple", None, None, [("l", "x"), (None, "")]), None, None, None), (3, "", "q", ("multiple", "v", None, []), "v", "w", None),
            (4, "", "q", ("multiple", "v", None, None), "v", "w", None), (5, "", "q", (None, "v", None, None), "v", "w", None), (6, "", None, None, "", "w", "own"), (7, "", None, None, None, "w", ""), (8, "", None, None, None, None, None),
        ], schema)
    rows = sorted(tuple(r) for r in answers.table_rows(history).collect())
    assert rows == [
        (1, 0, "c", "q", "l", "5 Kč", "number", "5"), (2, 0, "", "Dotaz", "l", "x", "text", ""), (2, 1, "", "Dotaz", "Výsledek", "", "text", ""),
        (6, 0, "", "Dotaz", "own", "", "text", ""), (7, 0, "", "Dotaz", "Výsledek", "w", "text", ""), (8, 0, "", "Dotaz", "Výsledek", "", "text", ""),
    ]
    cats = spark.createDataFrame([("q", "old", 1), ("q", "new", 2)], "query string, category string, ord int")
    got = answers.with_category(spark.createDataFrame([("q",), ("r",)], "query string"), cats)
    assert sorted(map(tuple, got.collect())) == [("q", "new"), ("r", "Ostatní")]


def test_merged_spans_do_not_overlap(spark):
    docs = spark.createDataFrame([(1, "then the attention"), (2, "")], "doc_id long, text string")
    spans = highlight.merged(highlight.occurrences(docs, ["the", "then", ""]), docs)
    assert sorted((r.start, r.end, r.value) for r in spans.collect()) == [(0, 4, "then"), (5, 8, "the")]


def test_same_answers_under_other_partitions(spark):
    rows = lambda: sorted(map(tuple, plans.QUERIES["WIN-03"](spark, D).collect()))
    first = rows()
    spark.conf.set("spark.sql.shuffle.partitions", "31")
    try:
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_intents(spark):
    q = spark.createDataFrame([(1, "číslo a účet"), (2, "nic")], "query_id int, query string")
    rows = search.intents(q).orderBy("query_id", "intent_ord").collect()
    assert [r.pattern for r in rows if r.query_id == 1] == ["birthNumber", "companyId", "contractNumber", "bankAccount"] and sum(r.query_id == 2 for r in rows) == 12


def test_offset_maps_align_from_left_to_right(spark):
    rnd = random.Random(3)
    texts = ["**Tučná** [o](u)\n# Nadpis", "", None, "bez značek", "* a\n* b *c*", "x" * 700 + "**y**" + "z" * 700, "- -x", "1. 1. a", "İİ **i**", "**a\u0301\u0301**", "\U0001f600 *\U0001f600*", "**a** b\n- c " * 200]
    texts += ["".join(rnd.choice(["a", "b", "**", "*", "_", "- ", "\n", "[", "](u)", "1. ", "# ", "`", "é", " "]) for _ in range(rnd.randrange(30))) for _ in range(400)]
    rows = locate.with_offset_map(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    normal = F.col("normal")
    assert rows.where(~normal.eqNullSafe(N.normalized(F.col("text")))).count() == 0
    places = F.transform(F.sequence(F.lit(0), F.length(F.coalesce(normal, F.lit(""))) + 1), lambda p: locate.original_place(p, F.col("offset_map")))
    got = rows.select("text", N.remove_markdown(F.col("text")).alias("clean"), "normal", locate.index_map(F.col("offset_map")).alias("m"), "offset_map", places.alias("places")).collect()
    for r in got:
        want, at = [], 0
        for i, c in enumerate(r.text or ""):
            if at < len(r.clean) and r.clean[at] == c:
                want.append(i)
                at += 1
        size = len(r.normal or "")
        assert r.m == [want[i] if i < len(want) else i for i in range(size)]
        assert r.places == [r.m[p] if p < size else p for p in range(size + 2)] and len(r.offset_map.runs) <= size
    back = locate.reverse_map(rows).collect()
    want = {}
    for i, r in enumerate(got):
        for place, o in enumerate(r.m):
            want.setdefault((texts.index(r.text) if r.text in texts else i, o), []).append(place)
    mine = {}
    for r in back:
        mine.setdefault((texts.index(texts[r.doc_id]), r.original), r.normalized)
    assert mine == {k: sorted(set(v)) for k, v in want.items()}


def test_places_where_any_value_begins(spark):
    cases = [("aaaa", ["aa"]), ("abcabc", ["abc", "bca", "c"]), ("", ["a"]), ("x", []), ("a\\E(b)a\\E", ["a\\E", "(b)"]), ("žížala", ["ž", "ala"]), ("\U0001f600b\U0001f600", ["b", "\U0001f600"]), (".*", [".", "*"])]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, v array<string>").orderBy("i").select(locate.starts_of(F.col("t"), F.col("v"))).collect()
    assert [r[0] for r in rows] == [[p for p in range(len(t)) if any(t.startswith(x, p) for x in v)] for t, v in cases]


def test_searches_tell_what_they_gave(spark):
    rows = [(1, "q", 0, "a", "x"), (1, "q", 1, None, "y"), (1, "q", 2, None, "y"), (1, "p", 0, None, None)]
    given = spark.createDataFrame(rows, "doc_id int, query_id string, item int, label string, value string")
    places = spark.createDataFrame([(1, "y", 5), (1, "y", 9), (2, "x", 1)], "doc_id int, value string, start int")
    got = {r.query_id: (r.result_count, [tuple(x) for x in r.results]) for r in audit.searches(given, places).collect()}
    assert got == {"q": (3, [("a", "x", 0), (None, "y", 2), (None, "y", 2)]), "p": (1, [(None, None, 0)])}
    assert {r.query_id: (r.result_count, len(r.results)) for r in audit.searches(given, places, shown=2).collect()} == {"q": (3, 2), "p": (1, 1)}


def test_no_result_of_a_search_is_left_out(spark):
    given = spark.range(2500).selectExpr("1 AS doc_id", "'q' AS query_id", "CAST(id AS INT) AS item", "'a' AS label", "CONCAT('v', id) AS value")
    places = spark.createDataFrame([(1, "v2400", 5), (1, "v2400", 9)], "doc_id int, value string, start int")
    told = audit.searches(given, places).collect()
    assert [(r.result_count, len(r.results), r.results[2400].match_count) for r in told] == [(2500, 2500, 2)]
    rows = audit.search_results(given, places).collect()
    assert len(rows) == 2500 and {r.result_count for r in rows} == {2500} and {r.value for r in rows if r.match_count} == {"v2400"}


def test_mentions_of_one_place_are_sorted_before_they_meet_the_queries(spark):
    cols = "doc_id int, pattern string, type string, value string, start int, end int, context string, pattern_no int, match_ord int"
    given = [(1, p, p, v, s, s + len(v), "kde", n, m) for p, v, s, n, m in [("a", "x", 0, 0, 0), ("b", "x", 0, 0, 0), ("c", "x", 0, 1, 0), ("c", "x", 0, 0, 3), ("b", "y", 0, 0, 1), ("a", "x", 0, 0, 0), ("c", "x", 5, 0, 1)]]
    asks = {1: ["a", "b", "c"], 2: ["c", "a"], 3: ["b"], 4: ["c", "b", "c"]}
    asked = spark.createDataFrame([(q, str(q), "kde", ["kde"], [p], i, p) for q, ps in asks.items() for i, p in enumerate(ps)], "query_id int, query string, folded string, words array<string>, wanted array<string>, intent_ord int, pattern string")
    first = {}
    for d, p, _, v, s, e, _, n, m in given:
        for q, ps in asks.items():
            for i, x in enumerate(ps):
                if x == p:
                    first[q, s, e, v] = min(first.get((q, s, e, v), (99,)), (i, n, m, p))
    rows = search.deduplicated(spark.createDataFrame(given, cols), asked)
    got = [((r.query_id, r.start, r.end, r.value), (r.intent_ord, r.pattern_no, r.match_ord, r.pattern)) for r in rows.collect()]
    assert len(got) == len(first) and dict(got) == first
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.index("Join") < plan.index("doc_id", plan.index("Window [collect_list"))


def test_statistics_of_nothing(spark):
    empty = spark.createDataFrame([], "type string, value string, confidence double, start_position int, match_count int")
    assert tuple(report.statistics(empty).first()) == (0, 0, 0.0, 0.0, None, None, None, 0, None, None)


def test_confidences_by_origin(spark):
    rows = spark.createDataFrame([("api", False, 0.1), ("batch", False, None), ("batch", True, 0.7), ("batch", None, 0.7), (None, True, 0.0), ("local", None, 0.4)], "origin string, failed boolean, confidence double")
    assert [r.confidence for r in results.with_confidence(rows, "origin", "failed").collect()] == [0.95, 0.95, 0.0, 0.95, 0.9, 0.4]


def test_values_are_placed_with_overlaps_and_by_type(spark):
    docs = spark.createDataFrame([(1, "aaa **Částka** 12,5 % a 12,5 Kč"), (2, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "aa", "text"), (1, "ČÁSTKA", "text"), (1, "12,5 %", "rpsn"), (1, "", "text"), (1, None, None), (2, "aa", "text")], "doc_id int, value string, type string")
    got = {(r.value, r.start, r.end, r.text) for r in locate.value_places(asked, docs).collect()}
    assert {("aa", 0, 2, "aa"), ("aa", 1, 3, "aa"), ("ČÁSTKA", 6, 12, "Částka")} <= got and all(v != "" for v, *_ in got)


def test_individual_values(spark):
    docs = spark.createDataFrame([(1, "Jan Novák, 940919/1022, cena 7 850 000 Kč a 5,9 %, účet 12345678/0800")], "doc_id int, text string")
    said = spark.createDataFrame([(1, "JE TO Jan Novák a 940919/1022, 7 850 000 EUR, účet 12345678/0800; Petr Malý")], "doc_id int, answer string")
    got = {(r.kind, r.text) for r in locate.individual_values(said, docs).collect()}
    assert {("birthNumber", "940919/1022"), ("name", "Jan Novák"), ("amount", "7 850 000 Kč"), ("account", "12345678/0800")} <= got and ("name", "Petr Malý") not in got


def test_files_selection_and_refusals(spark, tmp_path):
    (tmp_path / "a.txt").write_text("jeden\ndva", encoding="utf-8")
    (tmp_path / "b.txt").write_text("tři", encoding="utf-8")
    assert sorted(r.text for r in files.contract_files(spark, str(tmp_path)).collect()) == ["jeden\ndva", "tři"]
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "hist_id int, item_idx int")
    assert results.only_selected(rows, rows.where("false"), ["hist_id", "item_idx"]).count() == 3
    assert results.without_history(rows, rows.where("item_idx = 1")).collect() == [(2, 0)]
    asked = spark.createDataFrame([("q", "d"), (" \n", "d"), ("q", None)], "q string, d string")
    assert [r[0] for r in asked.select(requests.refusal(F.col("q"), F.col("d"))).collect()] == [None, "query", "document"]
    words = spark.createDataFrame([("Žena",), ("zebra",), ("čas",), ("dum",)], "w string").withColumn("o", F.lit(0))
    assert [r.w for r in results.sorted_by(words, "w", "o").orderBy("position").collect()] == ["čas", "dum", "zebra", "Žena"]


def test_every_asked_pattern_meets_its_questions(spark):
    rows = plans.QUERIES["JOI-01-rows"](spark, D)
    asked = search.intents(plans.questions(spark))
    found = {r[0] for r in extract.mentions(corpus.contracts(spark, D)).join(asked, "pattern", "left_semi").select("pattern").distinct().collect()}
    assert {r[0] for r in rows.select("pattern").distinct().collect()} == found and {"fullName", "companyId", "purchasePrice"} <= found


def test_late_keywords_widen_whole_texts(spark):
    contract = corpus.contracts(spark, D).first()
    got = plans.QUERIES["QRY-02-whole"](spark, D)
    assert got.where(F.col("doc_id") == contract.doc_id).where(F.col("widened").startswith(contract.text) & F.col("widened").contains("(hledat také: ")).count() == 1


def test_yes_no_answers(spark):
    raw = ['{"answer":"Ano","fullContext":"x"}', '{"answer":"Ne"}', "{bad", "", "plain"]
    assert column(spark, lambda c: answers.yes_no(c)["answer"], raw) == ["Ano", *raw[1:]]
    assert column(spark, lambda c: answers.yes_no(c)["fullContext"], raw) == ["x", None, None, None, None]
    assert {r[0] for r in plans.QUERIES["JSON-03-whole"](spark, D).select(F.col("full_context").isNull()).distinct().collect()} == {True, False}


def test_rules_that_the_contracts_do_not_tell_apart(spark):
    assert column(spark, V.plausible_birth_number, ["940919-1022", "94.09.19 1022", "940919", "94091910222"]) == [True, True, False, False]
    docs = spark.createDataFrame([(1, "A  5, 110 00 B , Dlouhá 5, 110 00 Praha."), (2, "cena 7 850 000 KČ")], "doc_id int, text string")
    found = {(r.value.strip(), r.valid) for r in extract.checked(docs).where("pattern = 'address'").collect()}
    assert found == {("A  5, 110 00 B", False), ("Dlouhá 5, 110 00 Praha", True)}
    said = spark.createDataFrame([(2, "celkem 7 850 000 KČ"), (2, "7 850 000 EUR")], "doc_id int, answer string")
    assert {(r.start, r.end, r.text) for r in locate.individual_values(said, docs).collect()} == {(5, 17, "7 850 000 KČ")}
    assert column(spark, lambda c: answers.right_place(F.lit("Ulice Praha"), c), [" praha ", "Praha", "Brno"]) == [6, 6, None]


def test_results_outside_the_text_are_dropped(spark):
    text = "x" * 24 + "Praha"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [(24, 999, "Praha"), (9, 3, "Praha"), (-1, 4, "Praha"), (24, 29, " Praha "), (3, 8, " praha"), (3, 8, "Brno"), (3, None, "Praha")]
    rows = [(1, i, ("l", v, a, b, 0.9 if i % 2 else 0.0, "t", "")) for i, (a, b, v) in enumerate(spans)]
    given = spark.createDataFrame(rows, "doc_id long, item int, r struct<label:string,value:string,start:int,end:int,confidence:double,type:string,context:string>")
    got = sorted((r.item, r.value, r.start, r.end, round(r.confidence, 6)) for r in answers.verified(given, docs).collect())
    assert got == [(3, " Praha ", 24, 29, 0.9), (4, "Praha", 24, 29, 0.6)]


def test_small_tables_are_dealt_to_all_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    assert files.dealt(spark.range(9).coalesce(1)).rdd.getNumPartitions() == cores
    many = spark.range(9).repartition(cores + 3)
    assert files.dealt(many) is many


def test_spans_of_texts_that_hold_the_mark_or_nothing(spark):
    texts = ["a 12 b 3", "", None, f"x{extract.MARK} 7 {extract.MARK} 88", "12", "none", extract.MARK, "\U0001f600 5 é 6$1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in extract.placed(rows, [("digits", 0, "[0-9]+"), ("none", 3, "y{7}")], "i").orderBy("i", "match_ord").collect():
        assert (r.pattern, r.pattern_no, r.match_ord) == ("digits", 0, len(got[r.i]))
        got[r.i].append((r.start, r.end, r.value))
    assert got == {i: [(*m.span(), m.group()) for m in re.finditer("[0-9]+", t or "")] for i, t in enumerate(texts)}


def test_positions_under_any_partitions(spark):
    rnd = random.Random(6)
    rows = [(i, rnd.choice(["b", "a", None, "č", "c", "Č"])) for i in range(997)]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, "o int, w string").repartition(parts)
        got = [(r.position, r.o, r.w) for r in results.sorted_by(df, "w", "o").orderBy("position").collect()]
        order = {None: 0, "a": 1, "b": 2, "c": 3, "č": 4, "Č": 5}
        assert got == [(n + 1, *r) for n, r in enumerate(sorted(rows, key=lambda r: (order[r[1]], r[0])))]
        down = results.newest_first(df, "o", "o").orderBy("position").select("o").collect()
        assert [r.o for r in down] == list(range(996, -1, -1))
    assert results.sorted_by(df.limit(0), "w", "o").count() == 0


def test_an_export_without_its_manifest_is_not_read(spark, tmp_path):
    rows = spark.createDataFrame([("c", "q", 'a "b", c', "5", None, "text")], ", ".join(f"{c} string" for c in report.HEADERS))
    assert report.write_csv(rows, f"{tmp_path}/a") == 1
    assert [tuple(r) for r in report.read_csv(spark, f"{tmp_path}/a").collect()] == [("c", "q", 'a "b", c', "5", None, "text")]
    assert report.write_csv(rows.limit(0), f"{tmp_path}/none") == 0 and report.read_csv(spark, f"{tmp_path}/none").count() == 0
    rows.write.csv(f"{tmp_path}/half/data")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        report.read_csv(spark, f"{tmp_path}/half")


def test_rows_are_made_once_for_an_export(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(50).selectExpr("id ord", "'t' type", "cast(id as string) value", "0.5d confidence", "1 start_position", "1 match_count")
    assert report.write_workbook(rows.mapInArrow(count, rows.schema), f"{tmp_path}/w", ["ord"]) == 50 and made.value == 50
    assert set(report.read_workbook(spark, f"{tmp_path}/w")) == {"results", "summary", "types", "statistics"}


def test_search_reads_only_files_that_may_hold_the_term(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id", "concat('řádek číslo ', id, if(id = 1234, ' ZVLÁŠTNÍ', '')) as t", "cast(null as string) as u").repartitionByRange(16, "id")
    trigrams.write_indexed(rows, f"{tmp_path}/x", ["t", "u"])
    for term, most in (("zvláštní", 1), ("ČÍSLO 1234", 4), ("nikde", 0), ("slo", 16), ("ř", None)):
        files_read = trigrams.files_with(spark, f"{tmp_path}/x", term)
        assert most is None and files_read is None or len(files_read) <= most
        want = {r.id for r in report.containing(rows, ["t", "u"], term).collect()}
        assert {r.id for r in trigrams.search(spark, f"{tmp_path}/x", ["t", "u"], term).collect()} == want


def test_a_stream_stopped_and_started_again_gives_each_row_once(spark, tmp_path):
    texts = [f"Smlouva č. {i}/2024, rodné číslo: 940919/10{i:02}, cena 5 {i:03} CZK, splatnost do {i} dnů." for i in range(40)]
    out, at, where = f"{tmp_path}/out", f"{tmp_path}/at", f"{tmp_path}/in"
    for part in (texts[:15], [], texts[15:]):
        for i, t in enumerate(part):
            Path(where).mkdir(exist_ok=True)
            Path(f"{where}/{texts.index(t)}.txt").write_text(t, encoding="utf-8")
        stream = streams.contract_files(spark, where, files_at_once=4)
        docs = stream.select(F.regexp_extract("path", "([0-9]+)[.]txt$", 1).cast("long").alias("doc_id"), "text")
        run = streams.appended(extract.mentions(docs).withColumn("kind", V.value_type(F.col("value"))), out, at)
        run.awaitTermination()
        assert run.exception() is None
    whole = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = extract.mentions(whole).withColumn("kind", V.value_type(F.col("value")))
    plain_rows = lambda df: sorted(map(str, df.select(*sorted(want.columns)).collect()))
    assert plain_rows(spark.read.parquet(out)) == plain_rows(want) and want.count() > 100


def test_model_answers_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, '{"results":[{"query":"q","type":"single","value":"x"}]}'), (2, 0, "bad")], files.ANSWERS)
    rows.write.json(f"{tmp_path}/in")
    streams.appended(answers.flatten(streams.model_answers(spark, f"{tmp_path}/in")), f"{tmp_path}/out", f"{tmp_path}/at").awaitTermination()
    assert [(r.doc_id, r.query, r.value) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, "q", "x")]


def test_sketches_of_days_add_up(spark):
    rows = spark.range(60_000).selectExpr("id div 10000 as d", "cast(id % 20000 as string) as v", "if(id % 2 = 0, '', 'x') as w")
    days = report.distinct_sketches(rows.where("d < 3"), F.col("d"), ["v", "w"]).unionByName(report.distinct_sketches(rows.where("d >= 3"), F.col("d"), ["v", "w"]))
    about = report.merged_sketches(days, ["v", "w"]).first()
    assert abs(about.v - 20_000) < 600 and about.w == 1 and days.count() == 6


def brute_occurrences(text, value):
    out, at = [], text.find(value)
    while at >= 0:
        out.append(at)
        at = text.find(value, at + len(value))
    return out


def test_values_of_a_table_are_found_as_listed_ones(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abc ab") for _ in range(rnd.randrange(60))) for _ in range(60)] + ["a" * 2000, "", None, "Žluťoučký KŮŇ žlut", "\U0001f600ab\U0001f600ab", "\n\nab\n"]
    values = ["a", "ab", "aa", "abc", "abab", "ababa", "abcab cab", "aaaaaaa", "kun", "žluť", "\U0001f600ab", "\n", "nikde", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table = spark.createDataFrame(list(enumerate(values)), "value_ord int, value string")
    key = lambda df: sorted((r.doc_id, r.value_ord, r.start, r.end, r.value) for r in df.collect())
    got = key(highlight.occurrences_of(docs, table))
    plain_fold = lambda t: "".join({"ž": "z", "ť": "t", "ý": "y", "č": "c", "ů": "u", "ň": "n"}.get(c, c) for c in (t or "").lower())
    want = [(i, o, s, s + len(v), v) for i, t in enumerate(texts) for o, v in enumerate(values) if v for s in brute_occurrences(plain_fold(t), plain_fold(v))]
    assert got == sorted(want)
    assert highlight.occurrences_of(docs, table.limit(0)).count() == 0


def test_similar_words_by_bounds_are_all_similar_words(spark):
    rnd = random.Random(2)
    vocabulary = sorted({"".join(rnd.choice("aaeionrstkvcz19") for _ in range(rnd.randrange(1, 12))) for _ in range(1500)} | {"martha", "marhta", "cena", "cenu", "x" * 400})
    asked = ["cena", "martha", "rodne", "cislo", "a", "je", "rc", "smlouvy", "procentualni", "aaaa", "1999"]
    words, tokens = (spark.createDataFrame([(w,) for w in x], f"{n} string") for x, n in ((asked, "word"), (vocabulary, "token")))
    pairs = fuzzy.candidates(words, tokens).cache()
    got = {(r.word, r.token): r.score for r in fuzzy.scored(pairs).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    score = lambda a, b: round(0.7 * fuzzy.jaro_winkler(a, b) + 0.3 * (1 - distance(a, b) / max(len(a), len(b))), 6)
    want = {(a, b): s for a in asked for b in vocabulary if (s := score(a, b)) >= 0.6}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert pairs.count() == pairs.distinct().count() < 0.5 * len(asked) * len(vocabulary)


def test_tokens_of_very_many_documents_are_dealt_to_several_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"cena cenik {i} zzz") for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([("Cena",)], "query string")
    rows = lambda: sorted(map(tuple, fuzzy.nearest_tokens(docs, asked).collect()))
    want = rows()
    monkeypatch.setattr(fuzzy, "HOT", 0)
    assert rows() == want and len(want) == 600


def test_tokens_are_neither_stored_nor_moved_where_pairs_are_few(spark, monkeypatch):
    names, kept = [], fuzzy.stored
    monkeypatch.setattr(fuzzy, "stored", lambda df, name: names.append(name) or kept(df, name))
    texts = ["cena cenik 12 zzz", "Cenu, a cenu! č1ena 7" + "0" * 100_000, "777 888", "", None, "ce1na cenacena", "9cena_cen"]
    docs = spark.createDataFrame(list(enumerate(texts * 30)), "doc_id long, text string").repartition(5, "doc_id")
    asked = spark.createDataFrame([("Cena",), ("cenný ceník",)], "query string")
    rows = lambda: fuzzy.nearest_tokens(docs, asked, top=2)
    few = rows()
    assert "tokens" not in names
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") == 1  # that of the documents given
    got = sorted(map(tuple, few.collect()))
    assert {r[0] % 7 for r in got} == {0, 1, 5, 6} and max(r[4] for r in got) == 2
    monkeypatch.setattr(fuzzy, "LISTED", 0)
    assert sorted(map(tuple, rows().collect())) == got


def test_contracts_lie_by_document(spark):
    docs = corpus.contracts(spark, D)
    met = docs.join(corpus.answers(spark, D), "doc_id").groupBy("doc_id").count()
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == plan.count("Exchange hashpartitioning") == 2  # both of numbers only, before there are texts


def test_mentions_of_documents_that_lie_by_id_are_not_moved(spark):
    asked = spark.createDataFrame([(1, "Jaká je kupní cena"), (2, "kdo je kupující"), (3, "xyz")], "query_id int, query string")
    found, wanted = extract.mentions(corpus.contracts(spark, D)), search.intents(asked)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    lie, moved = search.answer(found, wanted, lie=True), search.answer(found, wanted)
    plans_of = [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (lie, moved)]
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    assert plans_of == [1, 2]  # the first deals the orders
    assert sorted(map(repr, lie.collect())) == sorted(map(repr, moved.collect())) and lie.count() > 0


def test_classes_hold_what_their_plain_forms_hold(spark):
    plain = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
    chars = spark.range(1, 0x10000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    P = extract.P
    for one, other in ((N.SP, plain), (P.CAPS, P.UP), (P.SMALL, P.LOW), (P.LOWER_RUN, f"[{P.LOW}{plain}]")):
        for flags in ("", "(?iu)"):
            assert chars.where(F.col("c").rlike(flags + one) != F.col("c").rlike(flags + other)).count() == 0
    assert chars.where(F.col("c").rlike(N.SP)).count() == 25


def test_marks_by_themselves_are_removed(spark):
    text = "e\u0301\u036f\u0300a ž\u0344Ž\u0340 \u0370 ǰ ſ İ"
    import unicodedata

    want = "".join(c for c in unicodedata.normalize("NFD", text) if not "\u0300" <= c <= "\u036f")
    got = spark.createDataFrame([(text,)], "t string").select(N.remove_diacritics(F.col("t"))).first()[0]
    assert got == want


def test_indexed_files_grow_in_number_with_the_rows(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(trigrams, "ROWS", 50)
    rows = spark.range(1000).select(F.col("id").alias("ord"), F.concat(F.lit("hodnota "), F.col("id")).alias("value"))
    trigrams.write_indexed(trigrams.dealt(rows, "ord"), str(tmp_path / "i"), ["value"])
    assert len(list((tmp_path / "i" / "rows").glob("*.parquet"))) == 20
    assert sorted(r.ord for r in trigrams.search(spark, str(tmp_path / "i"), ["value"], "A 77").collect()) == [77, *range(770, 780)]


def test_what_is_moved_for_requests_does_not_grow_with_the_chunks(spark):
    docs = spark.createDataFrame([(i, f" text {i}\t" + "x" * 500, "s") for i in range(20)], "doc_id long, text string, query_set string")
    for n in (1, 40):
        lists = spark.createDataFrame([("s", i, f"1. dotaz {i}") for i in range(n)], "query_set string, chunk_id int, listed string")
        parts = requests.request_parts(docs, lists)
        assert parts.count() == 20 and sum(len(r.document) for r in parts.collect()) == sum(len(f"text {i} " + "x" * 500) for i in range(20))
        prompts = {(r.doc_id, r.chunk_id): r.prompt for r in requests.rendered(parts).collect()}
        assert len(prompts) == 20 * n and prompts[3, n - 1] == "Dokument:\ntext 3 " + "x" * 500 + f"\n\nDotazy:\n1. dotaz {n - 1}"


def test_completed_results(spark):
    given = spark.createDataFrame([(1, "a", "l", "x"), (1, "a", None, None), (2, "z", "l", "unasked"), (None, "a", None, "no id")], "doc_id int, query string, label string, value string")
    asked = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (3, "a")], "doc_id int, query string")
    got = sorted(map(str, map(tuple, answers.completed(given, asked).collect())))
    assert got == sorted(map(str, [(1, "a", "l", "x"), (1, "a", None, None), (2, "z", "l", "unasked"), (None, "a", None, "no id"), (1, "b", None, "Nenalezeno"), (3, "a", None, "Nenalezeno")]))


def test_summary_of_answers_and_of_all_mentions(spark):
    docs = corpus.contracts(spark, D).limit(50)
    asked = search.intents(plans.questions(spark))
    found = extract.mentions(docs)
    rows = lambda x: sorted(map(tuple, search.summary(x, docs, plans.questions(spark)).collect()))
    assert rows(search.answer(found, asked)) == rows(search.deduplicated(found, asked))


def test_contracts_are_dealt_evenly(spark):
    """One row group is read by one of the many tasks of its file; the dear work on its rows must not stay there."""
    key = "spark.sql.files.maxPartitionBytes"
    saved = spark.conf.get(key)
    try:
        spark.conf.set(key, "4096")
        spark.conf.set("spark.sql.files.openCostInBytes", "1024")
        rows = [len(p) for p in corpus.contracts(spark, "/root/testdata/sf0.01").select("doc_id").rdd.glom().collect()]
    finally:
        spark.conf.set(key, saved)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(rows) == 15000 and max(rows) <= 1.2 * 15000 / spark.sparkContext.defaultParallelism


def test_hits_of_few_values_are_not_moved(spark, monkeypatch):
    """Values across the borders of parts, overlapping themselves, longer than a part, and short ones; the same places by either way."""
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("abč\n") for _ in range(900)) for _ in range(6)] + ["", None, "a" * 700, "xy" * 400]
    values = ["a", "ab", "bca"[:2], "aaaa", "abab", texts[0][200:320], texts[1][100:500], "a" * 300, "xy" * 150, "čab", "b\na"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(list(enumerate(values)), "value_ord int, value string")
    out = highlight.occurrences_of(docs, table)
    got = sorted(tuple(r) for r in out.collect())
    moved = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning" in x and "start#" in x.split("hashpartitioning")[1]]
    assert not moved
    monkeypatch.setattr(highlight, "FEW", 0)
    assert got == sorted(tuple(r) for r in highlight.occurrences_of(docs, table).collect())
    fold = lambda x: x.lower().replace("č", "c")
    want = [(i, m.start(), m.start() + len(v), v, o) for i, t in enumerate(texts) if t for o, v in enumerate(values) for m in re.finditer(re.escape(fold(v)), fold(t))]
    assert got == sorted(want)


def test_only_patterns_that_occur_cut_the_text(spark):
    rows = spark.createDataFrame([(1, "a 12"), (2, f"{extract.MARK}b 3 c 44")], "i int, text string")
    found = extract.placed(rows, [("digits", 0, "[0-9]+"), ("letters", 1, "[bc]")], "i")
    assert sorted(map(tuple, found.collect())) == [(1, "digits", 0, 0, 2, 4, "12"), (2, "digits", 0, 0, 3, 4, "3"), (2, "digits", 0, 1, 7, 9, "44"), (2, "letters", 1, 0, 1, 2, "b"), (2, "letters", 1, 1, 5, 6, "c")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(f", {extract.MARK}, -1)") == 1  # the marked text is cut once, in the row of its pattern, not for each pattern sought


def test_borders_and_numbers_are_told_apart_by_case_rules_of_ascii(spark):
    rows = spark.createDataFrame([(1, "ſsmlouva č. 5, Ičo 12345678, Kontrakt č. 7")], "doc_id int, text string")
    got = {(r.pattern, r.original_value) for r in extract.checked(rows).withColumnRenamed("value", "original_value").collect()}
    assert {("contractNumber", "smlouva č. 5"), ("companyId", "Ičo 12345678"), ("contractNumber", "Kontrakt č. 7")} <= got


def test_offset_maps_of_plain_stretches_are_not_made_by_character(spark):
    text = "**a** " + "slovo další " * 20_000 + "*b*"
    rows = locate.with_offset_map(spark.createDataFrame([(1, text)], "doc_id int, text string"))
    began = time.time()
    runs = rows.select("offset_map.runs").first()[0]
    assert [tuple(r) for r in runs] == [(0, 2), (1, 5), (240_002, 240_007)] and time.time() - began < 5


def test_markdown_is_left_alone_without_its_signs(spark):
    assert column(spark, N.remove_markdown, ["1. a", "\n\n+ b", "[x](y) [z]", "a_b", "~~q~~ `r`", None]) == ["a", "b", "x [z]", "a_b", "q r", None]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_segments_cost_their_text_once(spark):
    """The same pieces in one long text take about as long as in many short ones."""
    spans, text = [(i * 20 + 3, i * 20 + 9) for i in range(20_000)], "čtyři slova a šedesát " * 18_200
    text = text[:400_000]

    def took(docs, per_doc):
        docs = spark.createDataFrame(docs, "doc_id long, text string")
        merged = spark.createDataFrame(per_doc, "doc_id long, start int, end int")
        began = time.perf_counter()
        rows = [(r.doc_id, r.seg_start, r.content) for r in highlight.segments(merged, docs).collect()]
        return time.perf_counter() - began, rows

    short, _ = took([(i, text[i * 4000 : i * 4000 + 4000]) for i in range(100)], [(x // 4000, x % 4000, y - x + x % 4000) for x, y in spans])
    long, rows = took([(0, text)], [(0, x, y) for x, y in spans])
    ends = [0, *[x for span in spans for x in span], len(text)]
    assert sorted(rows) == [(0, a, text[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    assert long < 6 * short + 1


def test_segments_at_borders_of_blocks(spark):
    """Pieces that begin or end at a block's border, span several blocks, or reach beyond their text."""
    text = "".join(chr(0x1F600 + i % 50) if i % 3 == 0 else chr(97 + i % 26) for i in range(1100))
    cuts = [(0, 256), (256, 257), (300, 900), (1023, 1024), (1024, 1100)]
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "abc")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, a, b) for a, b in cuts] + [(4, 1, 9)], "doc_id long, start int, end int")
    got = sorted((r.doc_id, r.seg_start, r.kind, r.content) for r in highlight.segments(spans, docs).collect())
    gaps = [(257, 300), (900, 1023)]
    assert got == sorted([(1, a, "highlight", text[a:b]) for a, b in cuts] + [(1, a, "text", text[a:b]) for a, b in gaps] + [(4, 0, "text", "a"), (4, 1, "highlight", "bc")])


def test_individual_values_are_made_once(spark):
    said = spark.createDataFrame([(1, "7 850 000 Kč")], "doc_id long, answer string")
    docs = spark.createDataFrame([(1, "cena 7 850 000 Kč")], "doc_id long, text string")
    assert _plan(locate.individual_values(said, docs)).count("regexp_replace") == 2  # spaces and the currency


def test_flattened_answers_are_made_once(spark):
    made = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_id"), F.regexp_replace(F.col("id").cast("string"), "0", '{"results":[]}').alias("raw_text"))
    assert _plan(answers.flatten(made)).count("regexp_replace") == 1


def test_small_batches_leave_the_sessions_own_size(spark):
    own = spark.newSession()
    cluster.small_batches(own)
    assert own.conf.get(cluster.BATCH_BYTES) == "4m"
    own.conf.set(cluster.BATCH_BYTES, "9m")
    cluster.small_batches(own)
    assert own.conf.get(cluster.BATCH_BYTES) == "9m"


def test_texts_go_to_workers_in_small_batches(spark):
    """Texts of 12 MB in one partition reach a worker in several batches, once near_duplicates has seen their session."""
    from factloom.llm import parity_join

    own = spark.newSession()
    docs = own.range(0, 1200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("slovo "), 1700).alias("text"))
    parity_join.near_duplicates(docs.limit(2))
    sizes = [r.n for r in docs.mapInArrow(lambda batches: (b.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    assert sum(sizes) == 1200 and max(sizes) < 600
