"""The registered queries of this package: thin calls that apply an operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import byte_bpe, chat_format, exact_topk, fill_middle, fingerprints, license_scan, line_dedup, mixing, parity_join, token_counts, toxicity, url_filters, whitening
from factloom.llm.common import table
from factloom.sources.files import dealt


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    learn = table(spark, sf_dir, "labels").where(toxicity.fold(F.col("doc_id")) != 0)
    scored = toxicity.score(docs, toxicity.fit(docs, learn))
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.collapse(table(spark, sf_dir, "conversations"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = parity_join.near_duplicates(dealt(table(spark, sf_dir, "documents").select("doc_id", "text")), k=3, s=0.9, links_too=True)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.edited_and_next(docs, fingerprints.lexicon(dealt(docs)))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=1, least_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(vectors, components=4, scale=256)
    rows = whitening.whiten(vectors, model).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    explained = F.array(*[F.lit(x) for x in model.explained]).cast("array<double>")
    error = F.lit(model.identity_error).cast("double")
    return rows.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), error.alias("identity_error"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = fill_middle.fill_in_middle(docs, unit="line", seed=7, rate=100, spm=50)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_exact_topk": op2_exact_topk,
    "op3_token_counts": op3_token_counts,
    "op4_source_mix": op4_source_mix,
    "op5_license_scan": op5_license_scan,
    "op6_chat_format": op6_chat_format,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_fingerprints": op9_fingerprints,
    "op10_url_filter": op10_url_filter,
    "op11_line_dedup": op11_line_dedup,
    "op12_whitening": op12_whitening,
    "op13_fill_middle": op13_fill_middle,
}


def _level(name: str, rows: str, parent: str, key: str) -> str:
    """rate and strength of the groups of a level, shrunk towards their parents."""
    return f"""{name}_m AS (SELECT sum(k) / sum(n) AS m, sum(k * (k / n)) / sum(n) - (sum(k) / sum(n)) * (sum(k) / sum(n)) AS v FROM {rows} WHERE n > 0),
        {name}_s AS (SELECT CASE WHEN v > 1e-9 THEN least(greatest(m * (1 - m) / v - 1, 2.0), 200.0) ELSE 200.0 END AS strength FROM {name}_m),
        {name}_r AS (SELECT c.*, {name}_s.strength, (c.k + {name}_s.strength * p.rate) / (c.n + {name}_s.strength) AS rate FROM {rows} c JOIN {parent} p USING ({key}), {name}_s)"""


_RULES = sorted(url_filters.RULES, key=lambda r: -len(r[1] + r[2]))
_FITS = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in _RULES]
_SUFFIXES = ", ".join(f"'{s}'" for s in url_filters.SUFFIXES)

def _licenses() -> str:
    """VALUES of all templates: number, label, whether a base one, words, first k-gram that names the license, how many do."""
    rows = []
    for i, (label, phrase, name) in enumerate([*((a, b, b) for a, b in license_scan.BASE), *license_scan.MORE]):
        words, named = phrase.split(), name.split()
        at = next(p for p in range(len(words)) if words[p : p + len(named)] == named)
        rows.append(f"({i}, '{label}', {str(i < len(license_scan.BASE)).upper()}, {words}, {at}, {len(named) - license_scan.K + 1})")
    return "(VALUES " + ", ".join(rows) + ") t(template, label, is_base, words, name_at, name_n)"


#: DuckDB SQL for the queries that SQL can express.
ORACLES: dict[str, str] = {
    "op2_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 10""",
    "op5_license_scan": rf"""
        WITH w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{url_filters.UPPER}', '{url_filters.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        g AS (SELECT r, i - 1 AS place, w[i:i + 2] AS gram FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
        t AS (SELECT * FROM {_licenses()}),
        tg AS (SELECT template, label, is_base, len(words) - 2 AS grams, name_n, i - 1 AS tpos, i - 1 BETWEEN name_at AND name_at + name_n - 1 AS names, words[i:i + 2] AS gram FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM t)),
        d AS (SELECT r, template, any_value(label) AS label, any_value(is_base) AS is_base, any_value(grams) AS grams, place - tpos AS diagonal, min(place) AS low, max(place) AS high,
              count(*) AS held, count(*) FILTER (names) = any_value(name_n) AS named FROM g JOIN tg USING (gram) GROUP BY r, template, place - tpos),
        m AS (SELECT *, lag(diagonal) OVER o AS d0, lag(high) OVER o AS h0 FROM d WINDOW o AS (PARTITION BY r, template ORDER BY low, diagonal)),
        n AS (SELECT *, sum(CASE WHEN NOT is_base AND abs(diagonal - d0) <= 3 AND low > h0 AND low - diagonal > h0 - d0 THEN 0 ELSE 1 END) OVER (PARTITION BY r, template ORDER BY low, diagonal ROWS UNBOUNDED PRECEDING) AS run FROM m),
        f AS (SELECT r, any_value(label) AS label, any_value(is_base) AS is_base, min(low) AS start, CAST(sum(held) AS DOUBLE) / any_value(grams) AS share, bool_or(named) AS named FROM n GROUP BY r, template, run),
        k AS (SELECT *, is_base AND share = 1 AS whole, (is_base AND share = 1) OR (NOT is_base AND share >= 0.6 AND named) AS good FROM f),
        s AS (SELECT r, count(*) FILTER (whole) AS n_base, min(start) FILTER (whole) AS first_word, max(start) FILTER (whole) AS last_word,
              string_agg(DISTINCT label, ',' ORDER BY label) FILTER (whole) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (good) AS labels, max(share) FILTER (good) AS score FROM k GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
               coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score FROM w LEFT JOIN s USING (r)""",
    "op6_chat_format": """
        WITH t AS (SELECT DISTINCT conv_id, turn, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) AS x FROM conversations),
        c AS (SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, list(x ORDER BY turn NULLS FIRST, x.role, x.text) AS said FROM t WHERE conv_id IS NOT NULL GROUP BY 1
              UNION ALL SELECT conv_id, 1, [x] FROM t WHERE conv_id IS NULL),
        p AS (SELECT DISTINCT said[1:i] AS said FROM (SELECT said, unnest(range(1, n_turns)) AS i FROM c)), f AS (SELECT said, min(conv_id) AS first_id FROM c GROUP BY 1)
        SELECT conv_id, n_turns, first_id, array_to_string(list_transform(said, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '') AS text
        FROM c JOIN f USING (said) WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.said = c.said)""",
    "op8_jaccard_join": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{url_filters.UPPER}', '{url_filters.LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
              ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
        g AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM s),
        i AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS MATERIALIZED (SELECT x, y FROM i WHERE 100 * shared >= 90 * (nx + ny - shared)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
        c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1), d AS (SELECT x AS doc_id, count(*) AS n_links FROM l GROUP BY 1)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM s JOIN c USING (doc_id) LEFT JOIN d USING (doc_id)""",
    "op10_url_filter": rf"""
        WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
        r AS (SELECT *, CASE {" ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(_FITS, _RULES, strict=True))} END AS rule,
              CASE {" ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(_FITS, _RULES, strict=True))} END AS told FROM u),
        h AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, count(told)::DOUBLE AS n, count(CASE WHEN told = 'block' THEN 1 END)::DOUBLE AS k FROM r GROUP BY host),
        l AS (SELECT *, string_split(bare, '.') AS labels, regexp_matches(bare, '^[0-9]+(\.[0-9]+){{3}}$') AS address FROM h),
        t AS (SELECT *, array_to_string(labels[-2:], '.') IN ({_SUFFIXES}) AS listed FROM l),
        hosts AS (SELECT host, n, k, CASE WHEN address THEN bare WHEN listed THEN array_to_string(labels[-3:], '.') ELSE array_to_string(labels[-2:], '.') END AS domain,
                  CASE WHEN address THEN '' WHEN listed THEN array_to_string(labels[-2:], '.') ELSE labels[-1] END AS suffix FROM t),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2), suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k, 1 AS one FROM domains GROUP BY 1),
        whole AS (SELECT 1 AS one, (sum(k) + 1) / (sum(n) + 2) AS rate FROM suffixes), {_level("s", "suffixes", "whole", "one")}, {_level("d", "domains", "s_r", "suffix")}, {_level("e", "hosts", "d_r", "domain")}
        SELECT page_id, host, path, rule, coalesce(told, CASE WHEN rate - 1.645 * sqrt(rate * (1 - rate) / (n + strength + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN e_r USING (host)""",
    "op11_line_dedup": rf"""
        WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        k AS (SELECT doc_id, l, list_transform(l, lambda x: translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{line_dedup.UPPER}', '{line_dedup.LOWER}')) AS k FROM l),
        f AS (SELECT k FROM (SELECT doc_id, unnest(k) AS k FROM k) WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        e AS (SELECT doc_id, i, l[i] AS line, k[i] AS k FROM (SELECT doc_id, l, k, unnest(range(1, len(l) + 1)) AS i FROM k)),
        m AS (SELECT e.*, f.k IS NOT NULL AS gone FROM e LEFT JOIN f USING (k))
        SELECT doc_id, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op13_fill_middle": r"""
        WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        d AS (SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM u),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
              CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
        p AS (SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p""",
}
