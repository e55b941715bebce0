"""Text normalisation as column functions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache, reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the Unicode spaces that \s and trim stand for (for use in a class), one of them, and an ASCII word border, in Java's dialect.
#: Java asks the parts of a class one after the other, but for single characters up to 255, which are one part: rare ones stand behind one range that they lie in.
#: That range ends before the surrogates: a range across them makes Java read code points, pair by pair, at each place of a text.
SPACES = r" \t\n\x0B\f\r\x{00A0}\x{FEFF}[\x{1680}-\x{D7FF}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
SP = f"[{SPACES}]"
WB = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
TRIMMED = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"


@lru_cache(maxsize=1)
def _unaccented() -> tuple[str, str]:
    """All characters of the basic plane that lose their marks and stay one character, and what they become."""
    pairs = []
    for code in range(0xC0, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not "̀" <= c <= "ͯ")
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c), c evaluated once, however often f uses it: within a branch of a condition Spark does not share it."""
    return F.transform(F.array(c), lambda x: f(x))[0]


def js_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIMMED))


def or_default(c: Column, default) -> Column:
    """default where c is null, empty or zero."""
    default = default if isinstance(default, Column) else F.lit(default)
    return F.coalesce(F.nullif(c, F.lit("")), default)


def remove_diacritics(c: Column) -> Column:
    marked, bare = _unaccented()
    return F.translate(c, marked + "".join(map(chr, range(0x300, 0x370))), bare)  # marks by themselves become nothing


def fold(c: Column) -> Column:
    return remove_diacritics(F.lower(c))


def remove_markdown(c: Column) -> Column:
    """Markdown off, in ten ordered rewrites, each in time proportional to the text.

    The line rules may eat blank lines before an item, and a link may reach far. Where such a rule fails, every later start in the same stretch
    fails as well, so the stretch is matched by a further alternative and put back as it is. A rule is tried only on texts that hold one of the signs it needs.
    """
    for signs, pattern, to in (
        (["**"], r"\*\*([^*]+)\*\*", "$1"),  # bold
        (["*"], r"\*([^*]+)\*", "$1"),  # italic
        (["__"], r"__([^_]+)__", "$1"),
        (["_"], r"_([^_]+)_", "$1"),
        (["~~"], r"~~([^~]+)~~", "$1"),  # struck out
        (["`"], r"`([^`]+)`", "$1"),  # code
        (["#"], rf"(?m)^#{{1,6}}{SP}+", ""),  # headers
        (["-", "*", "+"], rf"(?m)^{SP}*+[-*+]{SP}+|(^{SP}++)", "$1"),  # lists
        (["."], rf"(?m)^{SP}*+[0-9]++\.{SP}+|(^{SP}++)", "$1"),
        (["]("], r"\[([^\]]+)\]\([^)]+\)|(\[[^\]]*+(?:\z|\](?!\()|\]\([^)]*+\z))", "$1$2"),  # links
    ):
        c = once(c, lambda t, p=pattern, to=to, signs=signs: F.when(reduce(or_, [t.contains(x) for x in signs]), F.regexp_replace(t, p, to)).otherwise(t))
    return c


def normalized(c: Column) -> Column:
    return F.lower(remove_diacritics(remove_markdown(c)))


def normalized_for_model(c: Column) -> Column:
    c = F.regexp_replace(remove_diacritics(c), "\t", " ")
    return js_trim(F.regexp_replace(F.regexp_replace(c, " +", " "), "\n{3,}", "\n\n"))


def reduction(original: Column, shorter: Column) -> Column:
    """Percent of characters saved; null for an empty original."""
    return F.round((1 - F.try_divide(F.length(shorter), F.length(original))) * 100)
