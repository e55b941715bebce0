"""The catalogue's expressions: equal to their plain forms on random texts, and fit for runs of a million characters."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import textnorm as N
from factloom.functions import values as V
from factloom.operators import extract, locate
from factloom.operators import patterns as P

S = "\\s\ufeff"
U, L = "[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ]", "[a-záčďéěíňóřšťúůýž]"
LS, W = f"[a-záčďéěíňóřšťúůýž{S}]", "A-Za-z0-9_"
B = f"(?:(?<=[{W}])(?![{W}])|(?<![{W}])(?=[{W}]))"
M, G = rf"[0-9]{{1,3}}(?:[{S}.,][0-9]{{3}})*(?:[,.][0-9]{{1,2}})?[{S}]*", rf"[{W}{S}]*?"
PR, DAY, PA = rf"({M}(?:Kč|CZK|korun))", rf"([0-9]{{1,2}}[.{S}][0-9]{{1,2}}[.{S}][0-9]{{4}})", f"({U}{LS}+)"
#: plain forms: (regex, pieces of which the random texts are made)
PLAIN = {
    "birthNumber": (rf"{B}[0-9]{{6}}[{S}]*/[{S}]*[0-9]{{3,4}}{B}", ["123456", "/", " ", "\u00a0", "789", "0123", "a", "č", "_", "1"]),
    "fullName": (rf"{B}{U}{L}+[{S}]+{U}{L}+(?:[{S}]+{U}{L}+)?{B}", ["Jan", "Žan", "á", "Bé", "x", " ", "\n", "1", "A", "_"]),
    "address": (rf"{B}{U}{LS}+[{S}]+[0-9]+(?:/[0-9]+)?[a-zA-Z]?,[{S}]*[0-9]{{3}}[{S}]*[0-9]{{2}}[{S}]+{U}{LS}+", ["Ab", "Č", " ", "5", "/6", "b", ",", " 110 00 ", "110", "00", "Pr", "\u2003", "x", "Ab 5,", "Ab  6/7b,", " 110 00 Pr"]),
    "phoneNumber": (rf"(?:\+420[{S}]?)?(?:[0-9]{{3}}[{S}]?[0-9]{{3}}[{S}]?[0-9]{{3}}|[0-9]{{9}}){B}", ["+420", " ", "123", "4567", "a", "1", "č"]),
    "amount": (rf"(?i){B}{M}(?:Kč|CZK|korun|EUR|€){B}", ["1", "12", "123", "123", " ", " ", ".", ",", "czk", "Kč", "a", "č", "5000", "€", "\n"]),
    "bankAccount": (rf"{B}(?:CZ[0-9]{{2}}[{S}]?[0-9]{{4}}[{S}]?[0-9]{{4}}[{S}]?[0-9]{{4}}[{S}]?[0-9]{{4}}[{S}]?[0-9]{{4}}|[0-9]{{1,10}}[-/][0-9]{{4}}){B}", ["CZ12", " 1234", "1234", "-", "/", "0800", "12", "a", "č", " 1234 1234 1234 1234 1234"]),
    "parcelNumber": (rf"{B}[0-9]+/[0-9]+{B}(?![{S}]*[0-9]{{3}})", ["1", "23", "/", " ", "456", "a", "č", "  "]),
    "buildingNumber": (rf"(?i){B}č\.p\.[{S}]*[0-9]+(?:/[0-9]+)?|{B}číslo[{S}]*popisné[{S}]*[0-9]+(?:/[0-9]+)?", ["č.p.", "ČÍSLO", " ", "popisné", "12", "/3", "a", "."]),
    "czechDate": (rf"{B}[0-9]{{1,2}}\.[{S}]*[0-9]{{1,2}}\.[{S}]*[0-9]{{4}}{B}", ["1", "31", ".", ". ", " ", "2024", "a", "č"]),
    "contractNumber": (rf"(?i){B}(?:smlouva|kontrakt)[{S}]*(?:č\.|číslo)[{S}]*[{W}/-]+|{B}spis\.?[{S}]*zn\.?[{S}]*[{W}/-]+", ["SMLOUVA", "kontrakt", " ", "č.", "číslo", "5/2", "spis", ".", "zn", "-", "é"]),
    "companyId": (rf"(?i){B}IČO?[{S}]*:?[{S}]*[0-9]{{8}}{B}|{B}identifikační[{S}]*číslo[{S}]*:?[{S}]*[0-9]{{8}}{B}", ["IČO", "ič", ":", " ", "12345678", "9", "identifikační", "číslo", "x", " : "]),
    "vatNumber": (rf"(?i){B}DIČ[{S}]*:?[{S}]*CZ[0-9]{{8,10}}{B}", ["DIČ", "dič", ":", " ", "CZ", "12345678", "99", "x", "DIČ: CZ12345678"]),
    "purchasePrice0": (rf"(?i)kupní[{S}]+cena{G}činí{G}{PR}", ["kupní", " ", "cena", " činí ", "a", "Kupní cena a činí b 5 ", "123", "12", " 123", ".", "Kč", " czk", "5000", "\u00a0"]),
    "purchasePrice1": (rf"(?i)za[{S}]+cenu{G}{PR}", ["za cenu ", "ZA", " ", "cenu", "a", "123", "12", " 123", ".500", ",5", "Kč", "czk", "5000", "é"]),
    "purchasePrice2": (rf"(?i)celková[{S}]+cena{G}{PR}", ["celková cena ", "Celková", " ", "cena", "1", "123", " 123", ".", "korun", "4567"]),
    "paymentTerms0": (rf"(?i)splatnost{G}{DAY}", ["splatnost", " ", "1.2.2024", "31 12 2024", "a", "5", "é", "."]),
    "paymentTerms1": (rf"(?i)do{G}([0-9]+)[{S}]*(?:dnů|dní)", ["do", "DO", " ", "5", "14", "dnů", "dní", "x", "é", ","]),
    "paymentTerms2": (rf"(?i)nejpozději{G}{DAY}", ["nejpozději", " ", "1.2.2024", "a", "11 1 2024", "é"]),
    "propertyDescription0": (rf"(?i)parcela[{S}]+č\.[{S}]*([0-9]+/[0-9]+)", ["parcela č. ", " ", "č.", "5", "/6", "x"]),
    "propertyDescription1": (rf"(?i)pozemek[{S}]+parcelní[{S}]+číslo[{S}]*([0-9]+/[0-9]+)", ["pozemek parcelní číslo ", " ", "číslo", "5", "/6"]),
    "propertyDescription2": (rf"(?i)stavba[{S}]+na[{S}]+parcele[{S}]*([0-9]+/[0-9]+)", ["stavba na parcele", " ", "parcele", "5", "/6"]),
    "contractingParties0": (rf"(?i)prodávající:[{S}]*{PA}", ["prodávající:", " ", "Jan", "á", "1", "\n"]),
    "contractingParties1": (rf"(?i)kupující:[{S}]*{PA}", ["KUPUJÍCÍ:", " ", "Jan", "á", ","]),
    "contractingParties2": (rf"(?i)nájemce:[{S}]*{PA}", ["nájemce:", " ", "Ja", "x", "."]),
}
OURS = {s.name: s.regex for s in P.PATTERNS} | {f"{c}{i}": f"(?iu){r}" for c, _, rs in P.CLAUSES for i, r in enumerate(rs)}
RUN = 1_000_000
#: runs of what the expressions repeat, after beginnings that let them start
RUNS = ["a", "A", "á", "Aa ", " ", "\n", "\u00a0", "1", "12", "123 ", "123.", "1 ", "1/", "1/1 ", "1.", "1. 1. ", "-", "_", "do ", "do 1 ", "do", "za cenu ", "za cenu 123 ", "splatnost ", "1.1.", "IČ ", "CZ12 1234 ", "č.p.", "\U0001f600", "x[", "x[y](", "**", "* "]
BEGINNINGS = ["", "A", "Aa ", "Abc 5", "Abc ", "123456", "123", "IČO", "DIČ:", "č.p.", "smlouva č.", "spis", "číslo", "kupní cena činí ", "kupní cena", "za cenu", "splatnost ", "do ", "nejpozději ", "parcela č.", "prodávající: A", "1. 1", "1/1", "[x](", "+420"]


def spans(spark, texts, regex, group=False):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {i: [] for i in range(len(texts))}
    for r in extract.placed(rows, [("p", 0, regex)], "i").where(F.regexp_extract("value", regex, 1) != "" if group else F.lit(True)).collect():
        got[r.i].append((r.start, r.end))
    return {i: sorted(v) for i, v in got.items()}


@pytest.mark.parametrize("name", sorted(PLAIN))
def test_expressions_find_what_their_plain_forms_find(spark, name):
    regex, pieces = PLAIN[name]
    rnd = random.Random(name)
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 14))) for _ in range(3000)]
    plain = {i: [m.span() for m in re.finditer(regex, t)] for i, t in enumerate(texts)}
    assert sum(map(len, plain.values())) > 0 and spans(spark, texts, OURS[name], name[-1].isdigit()) == plain


def test_long_gaps_without_an_end_are_passed_over_whole(spark):
    late = "do " + "x " * 900 + "nic. do 14 dnů, za cenu " + "y" * 3000 + " 5 Kč, za cenu " + "z " * 2000 + "nic; za cenu 7 Kč"
    rows = spark.createDataFrame([(1, late)], "doc_id int, text string")
    got = {(r.pattern, r.value) for r in extract.mentions(rows, ["paymentTerms", "purchasePrice"]).collect()}
    assert got == {("paymentTerms", "14"), ("purchasePrice", "5 Kč"), ("purchasePrice", "7 Kč")}


def test_all_expressions_on_runs_of_a_million_characters(spark):
    texts = [r * (RUN // len(r)) + "!" for r in RUNS] + [b + r * RUN + "!" for b, r in zip(BEGINNINGS, " a1" * 9, strict=False)] + [b + " " * RUN for b in BEGINNINGS]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string").repartition(16, "doc_id").cache()
    assert rows.count() == len(texts)
    slow = {}
    for name, regex in OURS.items():
        began = time.time()
        rows.select(F.sum(F.size(extract.found(F.col("text"), regex)))).collect()
        slow[name] = time.time() - began
    for name, made in (("markdown", N.remove_markdown), ("model", N.normalized_for_model), ("table type", V.table_type), ("export type", V.export_type), ("trim", N.js_trim)):
        began = time.time()
        rows.select(F.sum(F.length(made(F.col("text"))))).collect()
        slow[name] = time.time() - began
    for kind, regex in locate.KINDS:
        began = time.time()
        rows.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(regex), F.lit(0))))).collect()
        slow[kind] = time.time() - began
    rows.unpersist()
    assert max(slow.values()) < 120, sorted(slow.items(), key=lambda x: -x[1])[:5]  # quadratic time would take hours


def test_blank_lines_take_time_in_proportion(spark):
    began = time.time()
    rows = spark.createDataFrame([("\n" * 30_000 + "- x",), ("[" * 30_000,), ("[a](" * 10_000,), ("a" + " " * 30_000 + "b",)], "t string")
    got = [r[0] for r in rows.select(N.js_trim(N.remove_markdown(F.col("t")))).collect()]
    assert got == ["x", "[" * 30_000, "[a](" * 10_000, "a" + " " * 30_000 + "b"] and time.time() - began < 10


def brute_markdown(t):
    for pattern, to in ((r"\*\*([^*]+)\*\*", r"\1"), (r"\*([^*]+)\*", r"\1"), (r"__([^_]+)__", r"\1"), (r"_([^_]+)_", r"\1"), (r"~~([^~]+)~~", r"\1"), (r"`([^`]+)`", r"\1"),
                        (r"(?m)^#{1,6}\s+", ""), (r"(?m)^\s*[-*+]\s+", ""), (r"(?m)^\s*[0-9]+\.\s+", ""), (r"\[([^\]]+)\]\([^)]+\)", r"\1")):
        t = re.sub(pattern, to, t)
    return t


def test_markdown_equals_its_plain_rules(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice(["[", "]", "(", ")", "[a]", "(b)", "\n", "\n", " ", "- ", "* ", "+", "1. ", "12.", "# ", "x", "**", "_", "`", "~~"]) for _ in range(rnd.randrange(25))) for _ in range(4000)]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(N.remove_markdown(F.col("t"))).collect()]
    assert got == [brute_markdown(t) for t in texts]


def test_a_text_is_searched_for_what_it_may_hold(spark):
    assert set(OURS.values()) - set(P.NEEDS) == {OURS["fullName"], OURS["phoneNumber"]}
    letters = sorted({c for need in P.NEEDS.values() for x in need for c in x if c.isalpha()})
    chars = spark.range(1, 0x10000).where("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')").alias("c"))
    missed = chars.where(F.expr(" OR ".join(f"(c RLIKE '(?iu)^{x}$' AND lower(c) != '{x}')" for x in letters)))
    assert {r.c for r in missed.collect()} == set(P.ODD_FORMS)
    odd = ["SPİS. zn. 5/2", "\u017fplatnost 1.1.2024", "DO 14 DNŮ", "Kupní  CENA a ČINÍ b 5 KČ", "pozemek parcelní číslo 5/6 \x01", "ıČ 12345679", "do \u212a 7 dní"]
    rows = spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string")
    got = {(r.doc_id, r.pattern, r.value) for r in extract.mentions(rows).collect()}
    assert got >= {(0, "contractNumber", "5/2"), (1, "paymentTerms", "1.1.2024"), (2, "paymentTerms", "14"), (3, "purchasePrice", "5 KČ"), (4, "propertyDescription", "5/6"), (5, "companyId", "12345679"), (6, "paymentTerms", "7")}


def test_contexts_of_folded_texts(spark):
    texts = ["Účet 12/0800, ČÁSTKA " + "é" * 150 + " 7 Kč", "e\u0301 Účet 12/0800 Ž", "İČO ΟΔΟΣ 12/0800 ΣΑΣ", "12/0800\x01 \u2000"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = extract.mentions(rows, folded=True).select("folded_context", N.fold(F.col("context")).alias("plain")).collect()
    assert len(got) >= 5 and all(r.folded_context == r.plain for r in got)
