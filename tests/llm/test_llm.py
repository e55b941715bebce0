"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from factloom.llm import byte_bpe, chat_format, exact_topk, fingerprints, graph, license_scan, mixing, parity_join, queries, token_counts, toxicity, url_filters

D = "/root/testdata/sf0.001"
RANKS = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node string, key string, part string"
ODD = [None, "", " \n\t", "a", "word " * 3000, "x" * 5000, "<|endoftext|> a<|endoftext|>", "Žluťoučký kůň — 日本語 😀 \x85\xa0 1234 don't", "Same text of several words here", "Same text of several words here", "same TEXT of several words here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, with null and repeated ids, and columns whose names clash with the operators' own."""
    rows = [(i, t, None, None if i % 3 else "s", None, 1.0, "n", "k", "p") for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None, None, None, None)]
    return spark.createDataFrame([*rows, rows[3]], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_token_counts(docs, odd):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for df in (docs, odd):
        for r in token_counts.count_tokens(df, P.path("byte_bpe_50k.json")).collect():
            assert (r.n_tokens, r.n_bytes) == (len(t.encode(r.text or "", add_special_tokens=False).ids), len((r.text or "").encode()))
    assert token_counts.count_tokens(odd.limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_token_counts_of_random_pieces():
    c, rnd = token_counts.Counter(open(P.path("byte_bpe_50k.json")).read()), random.Random(3)
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["".join(rnd.choice("ab cde<|>\n1") for _ in range(rnd.randrange(300))) for _ in range(200)] + ["".join(rnd.choice("abcdef") for _ in range(3000))]
    assert c.counts(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_byte_bpe(docs, odd):
    e = encoding()
    for df in (docs, odd):
        out = byte_bpe.encode(df, RANKS, P.PATTERN)
        assert set(df.columns) < set(out.columns)
        for r in out.collect():
            assert r.ids == e.encode_ordinary(r.text or "") and r.n_tokens == len(r.ids) and bytes(r.decoded) == (r.text or "").encode()
    assert {bytes(r.decoded) for r in byte_bpe.decode(byte_bpe.encode(odd, RANKS, P.PATTERN, check=False), RANKS).collect()} == {(t or "").encode() for t in [*ODD, "no id"]}


def brute_chats(rows):
    """Each conversation's turns compared with the beginnings of all longer ones."""
    chats = {}
    for r in {tuple(r) for r in rows}:
        chats.setdefault(r[0] if r[0] is not None else ("alone", *r), []).append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    chats = {k: [x[2:] for x in sorted(v)] for k, v in chats.items()}
    out = []
    for k, v in chats.items():
        if not any(len(w) > len(v) and w[: len(v)] == v for w in chats.values()):
            first = min((j for j, w in chats.items() if w == v and not isinstance(j, tuple)), default=-1)
            out.append((-1 if isinstance(k, tuple) else k, len(v), first, "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in v)))
    return sorted(out)


def test_chat_format(spark):
    schema, rnd, rows = "conv_id long, turn long, role string, text string", random.Random(11), []
    turns = [("user", "a"), ("assistant", "b"), ("user", ""), (None, None), ("usera", ""), ("user", "a")]
    for i in range(120):  # few different turns, so that many are snapshots or copies of others
        for t in range(rnd.randrange(1, 6)):
            rows.append((i, 3 * t, *turns[rnd.choice((0, 1, t % 6))]))
    rows += [(500 + i, t, "user", f"turn {t}") for i in range(300) for t in range(8 if i == 7 else 1 + i % 2)]  # a hot first turn, hot snapshots
    rows += [(900, 0, "user", "only here"), (901, 0, "user", "only here"), (901, 1, "user", "only here"), (902, 0, "user", "only here"), (902, 1, "user", "only here")]
    rows += [(None, None, "user", "lost"), (None, 1, "user", "a"), (None, 1, "user", "lost 2"), (950, None, "user", "x"), (950, 0, "user", "y")]
    rows += rows[:40]  # repeated rows
    rnd.shuffle(rows)
    given = spark.createDataFrame([(*r, "clash") for r in rows], schema + ", prefix string")
    whole = spark.read.parquet(f"{D}/conversations.parquet")
    for df, plain in ((given, rows), (whole, whole.select("conv_id", "turn", "role", "text").collect())):
        got = sorted((-1 if r.conv_id is None else r.conv_id, r.n_turns, -1 if r.first_id is None else r.first_id, r.text) for r in chat_format.collapse(df).collect())
        assert got == brute_chats(plain)
    assert chat_format.collapse(given.limit(0)).count() == 0 and any(name.startswith("op6_") for name in queries.QUERIES)


def test_byte_bpe_joins():
    e, coder, rnd = encoding(), byte_bpe.Coder(open(RANKS, "rb").read(), P.PATTERN), random.Random(5)
    for n in (30, 100, 1000, 9000):
        piece = "".join(rnd.choice("abcdefgh") for _ in range(n))
        assert coder.encode(piece) == e.encode_ordinary(piece)


def sets(rows, k):
    return [parity_join.shingles(r.text or "", k) for r in rows]


def brute_components(rows, k, num, den):
    s, parent = sets(rows, k), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        both = len(s[i] & s[j])
        if both and den * both >= num * len(s[i] | s[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            least[root(i)] = min(least.get(root(i), r.doc_id), r.doc_id)
    return sorted((r.doc_id if r.doc_id is not None else -1, len(s[i]), (least.get(root(i)) if s[i] else r.doc_id) or (0 if (least.get(root(i)) if s[i] else r.doc_id) == 0 else -1)) for i, r in enumerate(rows))


def variants(spark):
    """Near copies of all degrees around the threshold, chains among them, and short texts."""
    rnd, rows = random.Random(7), []
    for base in range(6):
        words = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([6, 15, 40, 120, 300]))]
        for _ in range(14):
            edited = list(words)
            for _ in range(rnd.randrange(0, max(2, len(words) // 9))):
                edited[rnd.randrange(len(edited))] = f"x{rnd.randrange(999)}"
            rows.append(" ".join(edited))
            if rnd.random() < 0.3:
                words = edited
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


@pytest.mark.parametrize(("k", "s"), [(3, 0.9), (5, 0.8)])
def test_jaccard_join(spark, docs, odd, k, s):
    for df in (docs, odd, variants(spark)):
        got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in parity_join.near_duplicates(df, k, s).collect())
        assert got == brute_components(df.collect(), k, round(s * 100), 100)


def brute_links(rows, k, num, den):
    s = sets(rows, k)
    out = [0] * len(rows)
    for i, j in combinations(range(len(rows)), 2):
        both = len(s[i] & s[j])
        if both and den * both >= num * len(s[i] | s[j]):
            out[i], out[j] = out[i] + 1, out[j] + 1
    return sorted((r.doc_id if r.doc_id is not None else -1, n) for r, n in zip(rows, out, strict=True))


@pytest.mark.parametrize(("k", "s", "side"), [(3, 0.9, 1024), (5, 0.8, 5)])
def test_jaccard_links(spark, docs, odd, monkeypatch, k, s, side):
    monkeypatch.setattr(parity_join, "SIDE", side)
    near = variants(spark).unionByName(variants(spark).where("doc_id % 5 = 0"))  # links within components, and copies
    for df in (docs, odd, near):
        rows = parity_join.near_duplicates(df, k, s, links_too=True).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_links) for r in rows) == brute_links(df.collect(), k, round(s * 100), 100)
    assert "n_links" in queries.op8_jaccard_join(spark, D).columns


def test_jaccard_join_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert parity_join.near_duplicates(none).count() == 0 and parity_join.one_of_each(none).count() == 0


def test_one_row_of_each_class(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, b, "x"), (5, a, "x"), (5, b, "x"), (7, c, "y"), (7, c, "y"), (7, c, "z"), (8, c + " end", "x"), (None, d, "x"), (None, d, "x"), (None, d + " end", "x"), (None, None, "x"), (9, " \n", "x"), (9, " \n", "x")]
    rows += [(7, c, "y")] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    out = parity_join.one_of_each(df)
    got = [tuple(r) for r in out.collect()]
    assert out.columns == df.columns and all(r in rows for r in got)
    assert sorted((r[0], r[1][0]) for r in got if r[0] and r[1].strip()) == [(1, "b"), (5, "a"), (7, "c")]  # id 5 names the class of a; 1 that of b
    assert sum((r[1] or "").startswith("d0") for r in got) == 1 and sum(not (r[1] or "").strip() for r in got) == 3 and len(got) == 7
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in parity_join.one_of_each(df.repartition(3)).collect())


def test_sketches_of_unlike_widths_bound_the_difference():
    rnd = np.random.default_rng(4)
    for n in (0, 1, 1023, 1025, 5000, 200_000):
        a = rnd.integers(0, 2**63, n).astype(np.uint64)
        b = np.append(a[: n // 2], rnd.integers(0, 2**63, n + 40).astype(np.uint64))
        one, two = parity_join.sketch(a), parity_join.sketch(b)
        w = min(len(one), len(two))
        far = parity_join.distances([one, one], [two, one])
        assert far[1] == 0 and far[0] <= len(np.setxor1d(a, b)) and (far[0] > 0.3 * len(np.setxor1d(a, b)) or n == 200_000)
        odd = [np.bincount((h % np.uint64(w * 8)).astype(np.int64), minlength=w * 8) & 1 for h in (a, b)]
        assert far[0] == (odd[0] ^ odd[1]).sum()


def test_spread_join_with_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") < 3000, F.lit(7)).otherwise(F.col("id")).alias("node"), "id")
    names = spark.createDataFrame([(7, "hot"), (4000, "one"), (9999, "none")], "node long, name string")
    got = {r.id: r.name for r in parity_join._spread(rows, names, "node").collect()}
    assert got == {i: "hot" if i < 3000 else "one" if i == 4000 else None for i in range(5000)}
    assert parity_join._spread(rows.limit(0), names, "node").count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 60), (60, 50), (70, 70)], "a long, b long")
    assert sorted(map(tuple, graph.components(edges).collect())) == [(i, 1) for i in range(2, 41)] + [(60, 50)]


def test_topk(spark):
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(300, 8)).round(1)
    v[100:150] = v[0]  # ties
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(1000, None), (1001, [None, 1.0]), (1002, [float("nan")] * 8), (1003, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    saved, exact_topk.SHARD = exact_topk.SHARD, 64
    try:
        got = sorted(map(tuple, exact_topk.top_k(df, F.col("vec_id") % 10 == 0).collect()))
    finally:
        exact_topk.SHARD = saved
    m, want = np.floor(v * 1024), []
    for q in range(0, 300, 10):
        order = [int(j) for j in np.lexsort((np.arange(300), -(m @ m[q]))) if j != q][:10]
        want += [(q, i + 1, j, int(m[j] @ m[q])) for i, j in enumerate(order)]
    assert got == want
    assert exact_topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_topk_broadcasts_nothing(spark):
    """Pairs of shards and query blocks grow with the square of the table, so no side of them may be sent to the driver."""
    rows = [(i, [float(i % 7), float(i % 11), float(-i)]) for i in range(600)]
    saved, exact_topk.SHARD = exact_topk.SHARD, 64
    try:
        out = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0)
        assert out.count() == 600
    finally:
        exact_topk.SHARD = saved
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_topk_of_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), *[(i, [float(i), 0.0]) for i in range(1, 14)]]
    got = exact_topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got)] == [(i + 1, 13 - i) for i in range(10)]


def test_url_filter_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{D}/pages.parquet'")
    plain = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert plain(queries.op10_url_filter(spark, D).collect()) == plain(con.execute(queries.ORACLES["op10_url_filter"]).fetchall())
    # a corpus in which the method itself blocks: rules decide some pages of a host, reputation the others
    urls = [f"http://h{i % 7}.net:{i % 3}80/{i}" for i in range(60)] + [f"http://x{i % 2}.example.com/{'de' if i % 3 else 'en'}/{i}" for i in range(60)]
    urls += [f"http://b.co.uk/fr/{i}" for i in range(9)] + ["http://a.b.co.uk:80/", "http://10.0.0.1:8080/x", "http://10.0.0.1/y", None, "x", "http://net/"] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    con.execute("CREATE OR REPLACE TABLE given (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?)", list(enumerate(urls)))
    want = con.execute(queries.ORACLES["op10_url_filter"].replace("FROM pages", "FROM given")).fetchall()
    got = url_filters.judge(df).select("page_id", "host", "path", "rule", "verdict").collect()
    assert plain(got) == plain(want) and any(r.rule is None and r.verdict == "block" for r in got)
    hosts = spark.createDataFrame([(h,) for h in ("a.b.co.uk:80", "10.0.0.1:8080", "x.example.com", "net", "", "co.uk")], "host string")
    told = {r.host: (r.domain, r.suffix) for r in url_filters.with_domain(hosts).collect()}
    assert told == {"a.b.co.uk:80": ("b.co.uk", "co.uk"), "10.0.0.1:8080": ("10.0.0.1", ""), "x.example.com": ("example.com", "com"), "net": ("net", "net"), "": ("", ""), "co.uk": ("co.uk", "co.uk")}


def test_topk_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{D}/embeddings.parquet'")
    assert sorted(map(tuple, queries.op2_exact_topk(spark, D).collect())) == sorted(con.execute(queries.ORACLES["op2_exact_topk"]).fetchall())


def test_mixing(docs, odd):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in rows)
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    again = mixing.mixed(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in rows)
    assert mixing.mix(odd).count() == odd.count() and mixing.mixed(odd).columns == odd.columns and mixing.mix(odd.limit(0)).count() == 0


def test_mixing_comes_near_its_targets(spark):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows, plain = mixing.mix(docs).collect(), {r.doc_id: r for r in docs.select("doc_id", "text", "source").collect()}
    sizes, taken = {}, {}
    for r in plain.values():
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    for r in rows:
        source = plain[r.doc_id].source
        assert r.size == words(plain[r.doc_id].text) and r.source_size == sizes[source] and r.taken <= 3 * r.size
        taken[source] = taken.get(source, 0) + r.taken
    off = {plain[r.doc_id].source: (taken[plain[r.doc_id].source], r.target) for r in rows}
    assert all(abs(got - target) <= max(50, 0.01 * target) for got, target in off.values()), off


def test_mixing_of_rows_that_differ_in_one_column(spark):
    rows = [(1, "same text here", "en", "a"), (1, "same text here", "en", "b"), (1, "same text here", "de", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(map(tuple, mixing.mixed(df, weights=(1, 2)).collect())) == sorted(rows)
    odd = spark.createDataFrame([("x7", "one two", "a"), ("8", "three", "a")], "doc_id string, text string, source string")
    assert sorted((r.doc_id is None, r.size) for r in mixing.mix(odd).collect()) == [(False, 1), (True, 2)]


def test_targets(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    weight, size = {"a": 5, "b": 2, "c": 1, None: 5}, {"a": 10, "b": 100, "c": 0, None: 1000}
    held = {}
    while True:  # the plain way: share, hold, share again
        rest = 1110 - sum(held.values())
        share = {k: rest * w / sum(weight[x] for x in weight if x not in held) for k, w in weight.items() if k not in held}
        over = {k: 3.0 * size[k] for k in share if share[k] > 3 * size[k]}
        if not over:
            break
        held |= over
    assert got == pytest.approx(held | share)


def test_flight_keeps_totals():
    rnd = np.random.default_rng(2)
    size, p = rnd.integers(1, 900, 500).astype(float), np.full(500, 0.37)
    z = mixing.flight(size, p, rnd.random(500))
    assert ((z > 0) & (z < 1)).sum() <= 2 and abs((z * size).sum() - 0.37 * size.sum()) < 1e-6 * size.sum() and abs(z.sum() - 185) < 1e-6


def test_license_scan(spark, odd):
    texts = [None, "", "Under the MIT License, under the mit license", "CC-BY-NC cc by nc", "Apache License, Version 2.0!", "apache license version 3", "Licensed under the Apache License, Version 2.0.", "cc by"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("words", F.lit("clash"))
    rows = {r.doc_id: r for r in license_scan.scan(df).collect()}
    phrases = [(a, b.split()) for a, b in license_scan.BASE]
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        hits = sorted((j, a) for a, b in phrases for j in range(len(words)) if words[j : j + len(b)] == b)
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None)
        assert r.base_labels == ",".join(sorted({a for _, a in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert license_scan.scan(odd).count() == odd.count() and license_scan.scan(odd.limit(0)).count() == 0


def test_license_spans_need_the_name(spark):
    wrong = ["released under the terms of the gnu general public license", "released under the terms of the agreement", "licensed under the apache license version 1 1",
             "This work is licensed under the GNU General Public License, version 2", "creative commons attribution 4 0 international license", "this source code form is subject to the terms of the agreement v 2 0"]
    wrong += ["all rights reserved " * 8, "licensed under the apache license version 3 of the"]
    right = {p: a for a, p, _ in license_scan.MORE} | {"This work is licensed under the new GNU General Public License, version 3.": "gpl-3", "released under all the terms of the MIT License": "mit"}
    df = spark.createDataFrame(list(enumerate([*wrong, *right])), "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert [(rows[i].labels, rows[i].score, rows[i].spans) for i in range(len(wrong))] == [("", 0.0, [])] * len(wrong)
    assert [rows[len(wrong) + i].labels for i in range(len(right))] == list(right.values()) and all(rows[len(wrong) + i].score >= 0.6 for i in range(len(right)))


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://NET/", "https://a.example.net/en/1?x#y", "http://x.example.com/de/q", "http://x.example.com", "http://b.org/fr/", "http://b.org/frx", "http://a.net?u=http://b.org/fr/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    rows = {r.page_id: r for r in url_filters.judge(df).collect()}
    assert [(rows[i].host, rows[i].path, rows[i].rule) for i in range(10)] == [("", "", None)] * 3 + [
        ("net", "/", "net/"), ("a.example.net", "/en/1", "example.net/en/"), ("x.example.com", "/de/q", "example.com/de/"), ("x.example.com", "", None),
        ("b.org", "/fr/", "org/fr/"), ("b.org", "/frx", None), ("a.net", "", None)]
    assert [rows[i].verdict for i in (3, 4, 5, 7)] == ["block", "allow", "block", "allow"] and {r.verdict for r in rows.values()} <= {"allow", "block"}
    assert url_filters.judge(df.limit(0)).count() == 0 and url_filters.judge(df.limit(1)).first().verdict == "allow"


def test_fingerprints(spark, docs, odd):
    for df in (docs, odd.where("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = sorted((r.doc_id, r.text or "") for r in df.collect())
        terms = fingerprints.lexicon(df)
        got = {r.doc_id: r for r in fingerprints.edited_and_next(df, terms).collect()}
        printer = fingerprints.Printer(terms)
        for (i, t), (j, u) in zip(rows, rows[1:] + rows[:1], strict=True):
            edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
            r = got[i]
            assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), printer.print(t), printer.print(edited))
            assert r.near_next == fingerprints.likeness(r.fingerprint, printer.print(u)) and 0 <= r.near_edited <= 1
    assert fingerprints.edited_and_next(odd, terms).count() == odd.count() and fingerprints.edited_and_next(odd.limit(0), terms).count() == 0
    assert fingerprints.fingerprints(odd, terms).count() == odd.count()


def test_toxicity(spark, docs, odd):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    model = toxicity.fit(docs, labels, block=8)  # several blocks

    def plain(text):
        counts = Counter(t for w in re.findall(r"\w+", text.lower()) for t in [w, w[:4] + "*" if len(w) > 4 else None, w[:5] + "*" if len(w) > 5 else None] if t in model.terms)
        v = {t: (1 + math.log(n)) * model.value[model.terms[t]] for t, n in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()} if length else v

    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    bank = [plain(texts[i]) for i in model.ids]
    assert len(bank) > 3 * model.size and set(model.label.tolist()) == {0, 1}
    assert {w for i in model.ids for w in re.findall(r"\w+", texts[i].lower())} <= set(model.terms)  # rare and common ones, of both labels
    for text in texts.values():
        v = plain(text)
        cosine = np.array([sum(x * e.get(t, 0.0) for t, x in v.items()) for e in bank])
        want = [i for i in np.lexsort((np.arange(len(cosine)), -np.round(cosine, 9))) if cosine[i] > 1e-12][: model.k]
        if not want:
            assert model.score(text) == (model.base, [])
            continue
        voted, (at, got) = model.vote(*model.found(text))
        assert np.allclose(got, cosine[want], atol=1e-9) and np.allclose(cosine[at], got, atol=1e-9)
        w = [model.weight[model.label[i]] / (1 - min(c, 1) + 0.05) for i, c in zip(at, got, strict=True)]
        assert abs(voted - sum(x for i, x in zip(at, w, strict=True) if model.label[i]) / sum(w)) < 1e-9
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert {r.score for r in rows if not (r.text or "").strip()} == {model.base}
    assert toxicity.score(odd.limit(0), model).count() == 0 and toxicity.score(odd, toxicity.fit(docs, labels.limit(0))).first().score == 0
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert all(e.doc_id is None for r in toxicity.score(docs.limit(20), toxicity.fit(*named)).collect() for e in r.evidence)


def test_isotonic():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 40):
        x, y = rng.permutation(n).astype(float), rng.integers(0, 2, n).astype(float)
        ys = y[np.argsort(x)]
        want = [max(min(ys[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(np.interp(np.arange(n), *toxicity.isotonic(x, y, np.ones(n))), want)


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.1"
    scored = queries.op1_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").select("score", "toxic").toPandas()
    rank, pos = scored["score"].rank(), scored["toxic"] == 1
    auc = (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc > 0.96


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{D}/documents.parquet")
    clean = corpus_pipeline.clean(spark, docs, D)
    assert clean.columns == docs.columns and clean.count() > 0.8 * docs.count()
    unlike = corpus_pipeline.unlike(spark, clean, D)
    rows = clean.collect()
    assert sorted(r.doc_id for r in unlike.collect()) == sorted({c for _, _, c in brute_components(rows, 5, 80, 100)})
    out = corpus_pipeline.run(spark, D).collect()
    assert out and all(r.round_trip and r.n_tokens == len(r.ids) for r in out)


def test_chat_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{D}/conversations.parquet'")
    got = queries.op6_chat_format(spark, D).select("conv_id", "n_turns", "first_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["op6_chat_format"]).fetchall())
    # snapshots, copies, repeated rows and nulls
    rows = [(i, t, "user", f"turn {t}" if t or i % 5 else None) for i in range(20) for t in range(1 + i % 4)] + [(None, 0, None, "alone"), (3, 0, "user", "turn 0")]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    con.execute("CREATE TABLE given (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO given VALUES (?, ?, ?, ?)", rows)
    want = con.execute(queries.ORACLES["op6_chat_format"].replace("FROM conversations", "FROM given")).fetchall()
    got = chat_format.collapse(given).select("conv_id", "n_turns", "first_id", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and len(want) < 20


def test_jaccard_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    got = queries.op8_jaccard_join(spark, D).select("doc_id", "n_shingles", "component_id", "n_links").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(queries.ORACLES["op8_jaccard_join"]).fetchall())


def test_documents_of_a_source_without_words_are_not_taken(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (2, "", "none"), (3, None, "none"), (4, "d e", "y"), (5, " \n", "none")], "doc_id long, text string, source string")
    rows = {r.doc_id: (r.size, r.target, r.copies, r.taken) for r in mixing.mix(docs).collect()}
    assert all(rows[i] == (0, 0.0, 0, 0) for i in (2, 3, 5)) and rows[1][2] + rows[4][2] > 0
    assert {r.doc_id for r in mixing.mixed(docs).collect()} <= {1, 4}


def plain_prints(df, low=0.001, high=0.1):
    """Fingerprints by their definition: terms of the band, sorted hashes of those that a subset keeps, hashed."""
    import math

    texts = [r.text or "" for r in df.select("text").collect()]
    words = lambda t: set(re.findall(r"\w+", t.lower()))
    often = {}
    for t in texts:
        for w in words(t):
            often[w] = often.get(w, 0) + 1
    band = {fingerprints._hash(w) for w, n in often.items() if max(2, low * len(texts)) <= n <= high * len(texts)}
    mask = 2**64 - 1

    def kept(term, j, rate):
        x = ((term ^ ((j + 1) * 0x9E3779B97F4A7C15 & mask)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 31)) * 0x94D049BB133111EB) & mask
        return (x >> 11) < math.floor(rate * 2**53)

    def one(text):
        own = sorted({fingerprints._hash(w) for w in words(text)} & band)
        if not own:
            return hashlib.blake2b((" ".join(sorted(words(text))) or text).encode(), digest_size=4).hexdigest() * len(fingerprints.RATES)
        slots = [[t for t in own if kept(t, j, rate)] for j, rate in enumerate(fingerprints.RATES)]
        return "".join(hashlib.blake2b(b"".join(t.to_bytes(8, "little") for t in s), digest_size=4).hexdigest() if s else "0" * 8 for s in slots)

    return one


def test_fingerprints_against_their_definition(spark, docs):
    one = plain_prints(docs)
    rows = {r.doc_id: r for r in fingerprints.edited_and_next(docs, fingerprints.lexicon(docs)).collect()}
    texts = sorted((r.doc_id, r.text or "") for r in docs.collect())
    same = lambda a, b: (lambda told: sum(x == y for x, y in told) / len(told))([(a[i : i + 8], b[i : i + 8]) for i in range(0, len(a), 8) if a[i : i + 8] != "0" * 8 or b[i : i + 8] != "0" * 8])
    for (i, t), (_, u) in zip(texts, texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (rows[i].fingerprint, rows[i].edited_fingerprint) == (one(t), one(edited))
        assert rows[i].near_edited == same(one(t), one(edited)) and rows[i].near_next == same(one(t), one(u))


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, f"lost {i % 3}") for i in range(400)] + [(5, f"again and again {i % 2}") for i in range(400)] + [(i, f"text number {i}") for i in range(10, 30)]
    df = spark.createDataFrame([(str(i) if i is not None else "x", t) for i, t in rows], "doc_id string, text string").repartition(5)  # ids that are no numbers are null
    got = fingerprints.edited_and_next(df, fingerprints.lexicon(df)).collect()
    hashed = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]]))
    want = [(i, hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()) for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True)]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.edited_sha256)) for r in got)
    one = df.limit(1)
    assert [r.near_next for r in fingerprints.edited_and_next(one, fingerprints.lexicon(one)).collect()] == [1.0]


def test_turns_of_one_place_and_role_are_in_the_order_of_their_texts(spark):
    rows = [(1, 0, "user", t) for t in "dbace"] + [(2, 0, "user", t) for t in "ab"] + [("x", 0, "user", "no number"), (1, 1, "assistant", "end")] + [(1, 0, "user", "c")] * 300
    df = spark.createDataFrame([(str(i), *r) for i, *r in rows], "conv_id string, turn long, role string, text string").repartition(4)
    got = {r.conv_id: re.findall(r"\n([^<\n]+)<", r.text) for r in chat_format.collapse(df).collect()}
    assert got == {1: [*"abcde", "end"], None: ["no number"]}  # 2 begins 1


def test_license_oracle(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{D}/documents.parquet'")
    con.execute("CREATE TABLE given (doc_id BIGINT, text VARCHAR)")
    rnd, phrases = random.Random(8), [p for _, p, _ in license_scan.MORE] + [p for _, p in license_scan.BASE]
    texts = [None, "", "licensed under the this work is gnu general public license version 3", "all rights reserved " * 90 + "no part of this publication"]
    for _ in range(400):  # phrases with words put in, left out or moved
        words = " ".join(rnd.choice(phrases) for _ in range(rnd.randrange(1, 4))).split()
        for _ in range(rnd.randrange(5)):
            at = rnd.randrange(len(words))
            words[at : at + rnd.randrange(2)] = rnd.choice([["new"], [], words[:3], words[at : at + 4][::-1]])
            words = words or ["none"]
        texts.append(" ".join(words))
    con.executemany("INSERT INTO given VALUES (?, ?)", list(enumerate(texts)))
    sql, columns = queries.ORACLES["op5_license_scan"], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(str, map(tuple, queries.op5_license_scan(spark, D).collect()))) == sorted(map(str, con.execute(sql).fetchall()))
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select(*columns).collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, con.execute(sql.replace("FROM documents", "FROM given")).fetchall()))
    told = {r.doc_id: r.labels for r in rows}
    assert told[2] == "" and len({r.labels for r in rows}) > 10


def test_mixing_of_rows_repeated_very_often(spark, monkeypatch):
    sizes = []
    level = mixing._level
    monkeypatch.setattr(mixing, "_level", lambda df: (sizes.append(df.groupBy("source", "block").count().agg(F.max("count")).first()[0]), level(df))[1])
    rows = [(7, "five words are in here", "a")] * 20_000 + [(i, "word " * (1 + i % 40), "ab"[i % 2]) for i in range(100, 1100)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6), weights=(1, 3)).collect()
    assert len(out) == len(rows) and max(sizes) < 2000 and all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in out)
    taken, target = {}, {r.source: r.target for r in out}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 0.002 * target[s] + 50 for s in target)
    assert {r.source_size for r in out if r.source == "a"} == {100_000 + sum(1 + i % 40 for i in range(100, 1100, 2))}


def test_a_task_keeps_the_hashes_of_a_bounded_number_of_words():
    from factloom.llm import parity_join

    hasher = parity_join.Hasher(3)
    kept = []
    for i in range(250):
        hasher(" ".join(f"w{i}x{j}" for j in range(1000)))
        kept.append(len(hasher.known))
    assert max(kept) <= 101_000 and (hasher("a b c") == parity_join.Hasher(3)("a b c")).all()
