"""op11, op12 and op13 against brute force, and on nulls, odd and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import fill_middle, line_dedup, queries, whitening

D = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"
CLASH = "doc_id long, text string, n_lines string, n_dropped string, place string, h1 string, output string, form string, n string"


def brute_lines(rows, least_chars, least_docs):
    """rows: (id, text). For each row its lines, how many go and what is left."""
    ascii_low = str.maketrans(line_dedup.UPPER, line_dedup.LOWER)
    cut = [[(x, x.translate(ascii_low).strip(WHITE)) for x in (t or "").split("\n")] for _, t in rows]
    docs = defaultdict(set)
    for (i, t), lines in zip(rows, cut, strict=True):
        for _, k in lines:
            docs[k].add(("no id", t) if i is None else i)
    gone = {k for k, v in docs.items() if len(v) >= least_docs and len(k) >= least_chars}
    return [(i, len(lines), sum(k in gone for _, k in lines), "\n".join(x for x, k in lines if k not in gone)) for (i, _), lines in zip(rows, cut, strict=True)]


def got_lines(df, **how):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.drop_lines(df, **how).collect()), key=str)


@pytest.mark.parametrize("least_chars,least_docs", [(1, 10), (3, 2), (1, 1)])
def test_line_dedup(spark, least_chars, least_docs):
    rnd, pool = random.Random(4), ["Hot line", "  hot LINE\t", "ŽLUŤ", "žluť", "", " ", "\x0bab\x0c", "\x85nel", "\xa0x", "ab", "unique"]
    rows = [(i, "\n".join(rnd.choice(pool) + (str(rnd.randrange(40)) if rnd.random() < 0.4 else "") for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "hot line\n" * 3000 + "end"), (104, "x" * 50_000), (None, "hot line\nlost"), (None, None), (None, "hot line\nlost")]
    rows += [rows[0]] * 12 + [(7, "another text of seven\nab")]  # repeated rows are one document
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "clash", "clash", "p", "h", "o", "f", "n") for r in rows], CLASH)
    assert got_lines(df, least_chars=least_chars, least_docs=least_docs) == sorted(brute_lines(rows, least_chars, least_docs), key=str)
    out = line_dedup.drop_lines(df)
    assert set(out.columns) == set(df.columns) and out.select("place").distinct().collect() == [("p",)] and line_dedup.drop_lines(df.limit(0)).count() == 0


def test_hot_and_other_lines_are_found_alike(spark, monkeypatch):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text")
    want = sorted(brute_lines([tuple(r) for r in docs.collect()], 1, 10), key=str)
    assert got_lines(docs) == want and sum(w[2] for w in want) > 0
    monkeypatch.setattr(line_dedup, "HOT", 0)  # none is broadcast
    assert got_lines(docs) == want


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "d", "w") for i, v in rows], "vec_id long, embedding array<float>, deviation string, whitened string")


def brute_whitening(rows, components=4, scale=256):
    good = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    sizes = defaultdict(int)
    for _, v in good:
        sizes[len(v)] += 1
    dim = max(sizes, key=lambda d: (sizes[d], d))
    good = [(i, tuple(int(np.floor(scale * c)) for c in v)) for i, v in good if len(v) == dim]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array(fit, dtype=float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    real = [j for j in np.argsort(-values)[:components] if values[j] > dim * 2.3e-16 * values.sum()]
    out = {}
    for i, x in good:
        centred = np.array(x) - np.array(sums) / n
        out[i] = (sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), [abs(float(centred @ vectors[:, j] / np.sqrt(values[j]))) for j in real])
    return n, out, [float(values[j] / values.sum()) for j in real]


def same_as_brute(df, rows, **how):
    model = whitening.fit(df, **how)
    got = {r.vec_id: (int(r.deviation), [abs(w) for w in r.whitened]) for r in whitening.whiten(df, model).collect()}
    n, want, explained = brute_whitening(rows, **how)
    assert model.n == n and got.keys() == want.keys() and model.explained == pytest.approx(explained, rel=1e-9)
    for i, (far, w) in want.items():
        assert got[i][0] == far and got[i][1] == pytest.approx(w, rel=1e-7, abs=1e-7)
    assert model.identity_error is None or model.identity_error < 1e-9


def test_whitening(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rnd.standard_normal(6) * [3, 2, 1.5, 1, 0.7, 0.2]]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)]  # copies count once in fitting
    odd = [(2000, None), (2001, [None, *rows[0][1][1:]]), (2002, [float("nan")] * 6), (2003, [float("inf"), *rows[0][1][1:]]), (2004, []), (2005, [1.0, 2.0]), (2006, [-0.0] * 6), (2007, [-0.001] * 6)]
    same_as_brute(vectors(spark, rows + odd), rows + odd)
    same_as_brute(vectors(spark, rows[:3]), rows[:3])  # rank 2
    repeated = whitening.whiten(vectors(spark, rows[:5] * 2 + [(None, rows[1][1])]), whitening.fit(vectors(spark, rows)))
    assert repeated.count() == 11 and set(repeated.columns) == {"vec_id", "embedding", "deviation", "whitened"}


def test_whitening_of_the_whole_table(spark):
    df = spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    same_as_brute(df, rows)
    out = queries.op12_whitening(spark, D).collect()
    assert len(out) == 4 * len(rows) and all(type(r.deviation) is int for r in out)


def test_whitening_without_rows_or_variance(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        model = whitening.fit(vectors(spark, rows))
        assert model.n == 0 and whitening.whiten(vectors(spark, rows), model).count() == 0
    same = vectors(spark, [(i, [1.0, 2.0, 3.0]) for i in range(5)])
    model = whitening.fit(same)
    assert model.n == 1 and [(r.deviation, r.whitened) for r in whitening.whiten(same, model).collect()] == [(0, [])] * 5
    with pytest.raises(ValueError):
        whitening.fit(same, max_dim=2)


def test_exact_sums_and_deviations_beyond_long():
    m = whitening.Model(256, 2, 10, [2**62, -3])
    x = np.array([[2**61, 5], [0, 0]], dtype=np.int64)
    assert m.deviation(x) == [(10 * a - 2**62) ** 2 + (10 * b + 3) ** 2 for a, b in x.tolist()] and whitening.exact_sums(x).tolist() == [[2**61, 5]]
    assert whitening.exact_sums(np.full((9, 1), 2**61)).tolist() == [[9 * 2**61]]


def test_eigenvectors_of_clusters_and_split_matrices():
    rnd = np.random.default_rng(2)
    for n, values in ((1, [3.0]), (2, [2.0, 1.0]), (9, [5.0] * 3 + [1.0] * 6), (40, [7.0, 7.0 - 1e-9, 7.0 - 2e-9, *np.linspace(0, 5, 37)]), (30, np.linspace(0, 1, 30) ** 9)):
        q, _ = np.linalg.qr(rnd.standard_normal((n, n)))
        for a in (q @ np.diag(values) @ q.T, np.diag(np.array(values, dtype=float))):
            a = (a + a.T) / 2
            got, vectors = whitening.leading(a, 4)
            k = min(4, n)
            assert got == pytest.approx(np.sort(np.linalg.eigvalsh(a))[::-1][:k], abs=1e-13 * max(1, abs(np.max(values))))
            assert np.abs(vectors @ vectors.T - np.eye(k)).max() < 1e-12 and np.abs(vectors @ a - got[:, None] * vectors).max() < 1e-12
    assert whitening.leading(np.zeros((3, 3)), 2)[0].tolist() == [0, 0]


UNITS = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s).", "word": r"(?:^[ \t\n\v\f\r]*)?[^ \t\n\v\f\r]+[ \t\n\v\f\r]*"}


def brute_middle(doc_id, text, unit="line", seed=7, rate=100, spm=50):
    text = text or ""
    pieces = re.findall(UNITS[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(pieces)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    # what no unit holds (white space alone) belongs to no unit: the rest of the text is the suffix
    prefix, middle = "".join(pieces[:a]), "".join(pieces[a:b])
    suffix = text[len(prefix) + len(middle) :]
    if n == 0 and text:
        prefix, middle, suffix = text, "", ""
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (n, "plain", None, None, text)
    if h4 % 100 < spm:
        return (n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}")


MIDDLES = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "Žluťoučký\nkůň 😀\n日本語", " lead\n\n trail \n ", "has <M> in it", "<P", "P>\n<", "x" * 300_000, "l\n" * 50_000, "\r\n\x85 \xa0z", "w " * 30_000]


@pytest.mark.parametrize("how", [{}, {"unit": "char"}, {"unit": "word", "seed": 3}, {"rate": 40, "spm": 0}, {"spm": 100, "seed": 1}])
def test_fill_in_middle(spark, how):
    rows = [(i, t) for i, t in enumerate(MIDDLES)] + [(None, "no\nid"), (3, "\n\n\n"), (3, "\n\n\n")] + [(100 + i, f"a {i}\n" * (i % 7) + "é" * (i % 3)) for i in range(80)]
    df = spark.createDataFrame([(*r, "l", "d", "p", "h", "o", "f", "n") for r in rows], CLASH)
    out = fill_middle.fill_in_middle(df, **how)
    got = sorted(((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=str)
    assert got == sorted(((*r, *brute_middle(*r, **how)) for r in rows), key=str)
    assert {g[3] for g in got} >= {"plain", "spm" if how.get("spm") != 0 else "psm"} and out.columns.count("output") == 1
    bad = out.where(fill_middle.restored(F.col("output"), F.col("form")) != F.coalesce("text", F.lit("")))
    assert bad.count() == 0 and fill_middle.fill_in_middle(df.limit(0)).count() == 0


def test_ranks_of_random_symbols():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rnd.integers(0, 5, n).astype(np.uint8)
        m, at = fill_middle.WaveletMatrix(symbols), np.arange(n + 1)
        for s in range(5):
            assert m.rank(s, at).tolist() == np.append(0, np.cumsum(symbols == s)).tolist()


def test_sentinels_that_cannot_be_told_apart_are_refused():
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>"), ("abc", "b", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.checked(bad)
    assert fill_middle.checked(fill_middle.SENTINELS) == ("<P>", "<S>", "<M>")
