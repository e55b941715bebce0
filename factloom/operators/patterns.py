"""The catalogue of patterns and clauses. Users may add PatternSpecs of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.textnorm import SP, SPACES, WB

# Letters, patterns, keywords and labels. Runs are single classes, which Java matches in a loop, not by recursion; where a
# run cannot be given back with success it is possessive (++), so that texts of any length take time in proportion.
UP, LOW = "[A-ZÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ]", "[a-záčďéěíňóřšťúůýž]"
#: the same letters, faster in Java: those beyond Latin-1 behind one range that they lie in
_RARE_UP, _RARE_LOW = (rf"[\x{{100}}-\x{{17F}}&&[{rare}]]" for rare in ("ČĎĚŇŘŠŤŮŽ", "čďěňřšťůž"))
CAPS, SMALL = f"[A-ZÁÉÍÓÚÝ{_RARE_UP}]", f"[a-záéíóúý{_RARE_LOW}]"
LOWER_RUN = f"[a-záéíóúý{_RARE_LOW}{SPACES}]"
#: a word border before an ASCII word character, after one, and a capital letter with a border before it (before a letter beyond ASCII, that is after a word character)
BEFORE, AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
CAPITAL = rf"{CAPS}(?:(?<=[A-Z])(?<![A-Za-z0-9_][A-Z])|(?<=[A-Za-z0-9_][ÁÉÍÓÚÝ{_RARE_UP}]))"
#: What begins a match is taken first, as a plain class, and the border before it is asked for afterwards: most places fail at once, and no place costs a look
#: around. Only words are matched without regard to case: a class that is, is slow in Java, so first letters are given in all their forms (with those beyond ASCII
#: that Java takes for them).
_K, _S, _I, _FORMS = r"[kK\x{212A}]", r"[sS\x{17F}]", r"[iI\x{130}\x{131}]", r"\x{130}\x{131}\x{17F}\x{212A}"
#: the first digit of a number that no word character stands before
DIGIT = "[0-9](?<![A-Za-z0-9_][0-9])"
_GROUPS = rf"(?:[{SPACES}.,][0-9]{{3}})*(?:[,.][0-9]{{1,2}})?{SP}*"
MONEY = rf"[0-9]{{1,3}}{_GROUPS}"
#: after its first digit: no start at three digits that an amount begun at the group of digits before would take in anyway
NOT_WITHIN = rf"(?![0-9]{{2}}(?![0-9])(?<={BEFORE}[0-9]{{1,3}}[{SPACES}.,][0-9]{{3}}))"
GAP = f"[A-Za-z0-9_{_FORMS}{SPACES}]*?"
#: a long gap without what is sought: later starts in it would fail too, so it is passed over whole
LONG = f"[A-Za-z0-9_{_FORMS}{SPACES}]{{1000,}}+"


@dataclass(frozen=True)
class PatternSpec:
    name: str
    type: str
    regex: str
    valid: Callable[[Column], Column] | None  # None: whatever the expression matches is
    normal: Callable[[Column], Column] = lambda c: c
    keywords: tuple[str, ...] = ()
    label: str | None = None


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _phone(c: Column) -> Column:
    return V.once(_digits(c), lambda d: F.when(d.startswith("420"), F.concat(F.lit("+420 "), F.substring(d, 4, 20))).otherwise(d))


def _amount(c: Column) -> Column:
    currency = F.regexp_extract(c, "(?iu)(Kč|CZK|korun|EUR|€)", 1)
    return F.concat(V.first_comma(F.regexp_replace(c, "[^0-9,.]", "")), F.lit(" "), F.when(currency == "", "Kč").otherwise(currency))


def _date_part(c: Column, i: int) -> Column:
    return F.regexp_extract(c, rf"([0-9]{{1,2}})\.{SP}*([0-9]{{1,2}})\.{SP}*([0-9]{{4}})", i)


def _date_ok(c: Column) -> Column:
    within = [V.once(_date_part(c, i).try_cast("int"), lambda x, low=low, high=high: x.between(low, high)) for i, low, high in ((1, 1, 31), (2, 1, 12), (3, 1900, 2100))]
    return F.coalesce(within[0] & within[1] & within[2], F.lit(False))


def _date(c: Column) -> Column:
    return F.concat_ws(".", F.lpad(_date_part(c, 1), 2, "0"), F.lpad(_date_part(c, 2), 2, "0"), _date_part(c, 3))


PATTERNS = [
    PatternSpec("birthNumber", "birthNumber", rf"{DIGIT}[0-9]{{5}}{SP}*+/{SP}*+[0-9]{{3,4}}{AFTER}", V.plausible_birth_number, V.no_spaces, ("rodné číslo", "rc", "narozen", "identifikace"), "Rodné číslo"),
    PatternSpec("fullName", "fullName", rf"{CAPITAL}{SMALL}+{SP}+{CAPS}{SMALL}+(?:{SP}+{CAPS}{SMALL}+)?{WB}", None, keywords=("jméno", "příjmení", "osoba", "pan", "paní"), label="Jméno a příjmení"),
    PatternSpec("address", "address", rf"{CAPITAL}{LOWER_RUN}{{2,}}+(?<={SP})[0-9]++(?:/[0-9]+)?[a-zA-Z]?,{SP}*+[0-9]{{3}}{SP}*+[0-9]{{2}}{SP}+{CAPS}{LOWER_RUN}+", lambda c: c.rlike(rf"[0-9]{{3}}{SP}*[0-9]{{2}}") & c.rlike(CAPS + SMALL), keywords=("adresa", "bydliště", "sídlo", "ulice"), label="Adresa"),
    PatternSpec("phoneNumber", "phoneNumber", rf"[+0-9](?:(?<=[0-9])[0-9]{{2}}|(?<=\+)420{SP}?[0-9]{{3}}){SP}?[0-9]{{3}}{SP}?[0-9]{{3}}{AFTER}", None, _phone, ("telefon", "mobil", "kontakt"), "Telefonní číslo"),
    PatternSpec("amount", "amount", rf"{DIGIT}{NOT_WITHIN}[0-9]{{0,2}}{_GROUPS}(?iu:Kč|CZK|korun|EUR|€){WB}", None, _amount, ("cena", "částka", "korun", "platba", "hodnota"), "Finanční částka"),
    PatternSpec("bankAccount", "bankAccount", rf"[C0-9](?<![A-Za-z0-9_][C0-9])(?:(?<=[0-9])[0-9]{{0,9}}[-/][0-9]{{4}}|(?<=C)Z[0-9]{{2}}{SP}?[0-9]{{4}}{SP}?[0-9]{{4}}{SP}?[0-9]{{4}}{SP}?[0-9]{{4}}{SP}?[0-9]{{4}}){AFTER}", None, V.no_spaces, label="Bankovní účet"),
    PatternSpec("parcelNumber", "parcelNumber", rf"{DIGIT}[0-9]*+/[0-9]++{AFTER}(?!{SP}*+[0-9]{{3}})", lambda c: ~(F.length(c).between(10, 11) & V.plausible_birth_number(c)), keywords=("parcela", "pozemek", "číslo parcely"), label="Parcelní číslo"),
    PatternSpec("buildingNumber", "buildingNumber", rf"[čČ](?<=[A-Za-z0-9_][čČ])(?:\.[pP]\.|(?iu:íslo){SP}*+(?iu:popisné)){SP}*+[0-9]+(?:/[0-9]+)?", None, lambda c: F.regexp_extract(c, "[0-9]+(?:/[0-9]+)?", 0), label="Číslo popisné"),
    PatternSpec("czechDate", "date", rf"{DIGIT}[0-9]?\.{SP}*+[0-9]{{1,2}}\.{SP}*+[0-9]{{4}}{AFTER}", _date_ok, _date),
    PatternSpec("contractNumber", "contractNumber", rf"[ksKS\x{{17F}}\x{{212A}}](?<![A-Za-z0-9_][ksKS\x{{17F}}\x{{212A}}])(?:(?:(?<={_S})(?iu:mlouva)|(?<={_K})(?iu:ontrakt)){SP}*+(?:[čČ]\.|(?iu:číslo))|(?<={_S})(?iu:pis)\.?{SP}*+(?iu:zn)\.?){SP}*+[A-Za-z0-9_/{_FORMS}-]+", None, lambda c: F.regexp_extract(c, "[A-Za-z0-9_/-]+$", 0), label="Číslo smlouvy"),
    PatternSpec("companyId", "companyId", rf"{_I}(?<![A-Za-z0-9_]{_I})(?:[čČ][oO]?|(?iu:dentifikační){SP}*+(?iu:číslo)){SP}*+(?::{SP}*+)?[0-9]{{8}}{AFTER}", lambda c: V.valid_company_id(F.regexp_extract(c, "[0-9]{8}", 0)), lambda c: F.regexp_extract(c, "[0-9]{8}", 0), label="IČO"),
    PatternSpec("vatNumber", "vatNumber", rf"[dD](?<![A-Za-z0-9_][dD])(?iu:IČ){SP}*+(?::{SP}*+)?[cC][zZ][0-9]{{8,10}}{AFTER}", lambda c: c.rlike("CZ[0-9]{8,10}"), lambda c: F.regexp_extract(c, "CZ[0-9]{8,10}", 0), label="DIČ"),
]
#: where an amount may begin in a gap: not at one or two digits that follow a digit, nor at a group that an earlier start takes in
_START = rf"(?:(?<![0-9])|(?=[0-9]{{3}}(?![0-9])))(?!(?<=[0-9][{SPACES}.,])[0-9]{{3}}(?![0-9]))"
_PRICE, _DAY = rf"{_START}({MONEY}(?iu:Kč|CZK|korun))", rf"([0-9]{{1,2}}[{SPACES}.][0-9]{{1,2}}[{SPACES}.][0-9]{{4}})"
_PARTY = rf"({CAPS}{LOWER_RUN}+)"
#: (clause, label, regexes with one group); matches without the group are passed over. Clauses are matched without regard to case; these turn that off (-iu) but for words
CLAUSES = [
    ("purchasePrice", "Kupní cena", [rf"(?-iu){_K}(?iu:upní){SP}++(?iu:cena){GAP}[čČ](?iu:iní){GAP}{_PRICE}", rf"(?-iu)[zZ][aA]{SP}++(?iu:cenu)(?:{GAP}{_PRICE}|{LONG})", rf"(?-iu)[cC](?iu:elková){SP}++(?iu:cena){GAP}{_PRICE}"]),
    ("paymentTerms", "Podmínky platby", [rf"(?-iu){_S}(?iu:platnost)(?:{GAP}{_DAY}|{LONG})", rf"(?-iu)[dD][oO](?:{GAP}(?<![0-9])([0-9]++){SP}*+[dD][nN][ůŮíÍ]|{LONG})", rf"(?-iu)[nN](?iu:ejpozději){GAP}{_DAY}"]),
    ("propertyDescription", "Popis nemovitosti", [rf"(?-iu)[pP](?iu:arcela){SP}++[čČ]\.{SP}*+([0-9]+/[0-9]+)", rf"(?-iu)[pP](?iu:ozemek){SP}++(?iu:parcelní){SP}++(?iu:číslo){SP}*+([0-9]+/[0-9]+)", rf"(?-iu){_S}(?iu:tavba){SP}++(?iu:na){SP}++(?iu:parcele){SP}*+([0-9]+/[0-9]+)"]),
    ("contractingParties", "Smluvní strana", [rf"(?-iu)[pP](?iu:rodávající:{SP}*+{_PARTY})", rf"(?-iu){_K}(?iu:upující:{SP}*+{_PARTY})", rf"(?-iu)[nN](?iu:ájemce:{SP}*+{_PARTY})"]),
]
#: letters that Java takes for s and i without regard to case, but that are others in lower case too: with one of them, a text is searched for all
ODD_FORMS = "ſİı"
_NEEDS = {
    "birthNumber": "/", "address": ",", "amount": "kč|czk|korun|eur|€", "bankAccount": "/|-|cz", "parcelNumber": "/", "buildingNumber": "č.p.|popisné", "czechDate": ".", "contractNumber": "smlouva|kontrakt|spis",
    "companyId": "ič|identifikační", "vatNumber": "dič", "purchasePrice": ("činí", "cenu", "celková"), "paymentTerms": ("splatnost", "dnů|dní", "nejpozději"), "propertyDescription": ("parcela", "pozemek", "stavba"),
    "contractingParties": ("prodávající:", "kupující:", "nájemce:"),
}
#: expression -> strings one of which is in the lower-cased text wherever it matches: to look for them is far cheaper than to search for the expression
NEEDS = {s.regex: _NEEDS[s.name].split("|") for s in PATTERNS if s.name in _NEEDS} | {f"(?iu){r}": need.split("|") for c, _, rs in CLAUSES for r, need in zip(rs, _NEEDS[c], strict=True)}
DEFAULT_LABEL, DEFAULT_CLAUSE = "Nalezený údaj", "Smluvní ustanovení"
#: (regex on the folded query, patterns), in order
INTENTS = [
    ("cena|castka|penize|kolik|hodnota|suma", ["amount", "purchasePrice"]),
    ("jmeno|osoba|kdo|prodavajici|kupujici|najemce", ["fullName", "contractingParties"]),
    ("rodne|rc|cislo", ["birthNumber", "companyId", "contractNumber"]),
    ("nemovitost|pozemek|parcela|stavba|dum|byt", ["parcelNumber", "buildingNumber", "propertyDescription"]),
    ("telefon|mobil|kontakt|adresa|bydliste", ["phoneNumber", "address"]),
    ("ucet|iban|banka", ["bankAccount"]),
    ("datum|kdy|termin|lhuta|splatnost", ["czechDate", "paymentTerms"]),
]
#: type -> regex on the folded query, for relevance
RELEVANT = {"birthNumber": "rodne|rc", "fullName": "jmeno|osoba", "amount": "cena|castka|penize", "phoneNumber": "telefon|mobil", "address": "adresa|bydliste", "parcelNumber": "parcela|pozemek"}
#: keyword -> what the query is widened by; the first that occurs counts
WIDER = {
    "jméno": "jméno, příjmení, celé jméno osoby, prodávající, kupující, nájemce, pronajímatel",
    "osoba": "jméno a příjmení, fyzická osoba, právnická osoba, smluvní strana",
    "rodné": "rodné číslo, RC, identifikační číslo osoby",
    "telefon": "telefonní číslo, mobil, kontakt, telefon",
    "adresa": "adresa bydliště, adresa sídla, ulice, město, PSČ, kontaktní adresa",
    "cena": "kupní cena, prodejní cena, cena díla, celková cena, konečná cena",
    "částka": "peněžní částka, suma, hodnota, finanční závazek, dlužná částka",
    "úrok": "úroková sazba, úrok z prodlení, RPSN, roční procento",
    "poplatek": "správní poplatek, poplatek za službu, bankovní poplatek",
    "účet": "bankovní účet, číslo účtu, IBAN, platební účet",
    "nemovitost": "pozemek, stavba, byt, dům, nemovitá věc, objekt",
    "parcela": "parcelní číslo, pozemková parcela, stavební parcela",
    "popisné": "číslo popisné, číslo evidenční, adresa objektu",
    "datum": "datum podpisu, datum uzavření, termín, lhůta, den",
    "lhůta": "termín plnění, lhůta splatnosti, doba trvání",
    "smlouva": "smluvní ujednání, kontrakt, dohoda, právní vztah",
    "podmínka": "smluvní podmínka, předpoklad, požadavek, omezení",
    "právo": "právní nárok, oprávnění, vlastnické právo",
    "povinnost": "závazek, povinnost, odpovědnost, břemeno",
}
#: head word -> synonyms
SYNONYMS = {"jméno": ["název", "osoba", "příjmení", "křestní"], "cena": ["částka", "hodnota", "suma", "kolik"], "rodné": ["číslo", "rc", "identifikátor", "identita"], "telefon": ["mobil", "číslo", "kontakt", "spojení"]}
