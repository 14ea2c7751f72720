"""The operators bound to the sample tables, with the SQL that computes the same rows."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import (
    ann_collisions,
    bpe_dp,
    jaccard_groups,
    language,
    lexical_search,
    line_rules,
    merkle,
    packing,
    pareto_mix,
    quality_pu,
    secrets,
    token_files,
    url_filter,
)
from ledgerline.llm.common import shared_folder, table
from ledgerline.session import ship_package

#: Folder of the public vocabularies; the same on every machine.
TOKENIZERS = os.environ.get("TOKENIZER_DIR") or os.path.dirname(public_tokenizers.__file__)
BYTE_BPE = os.path.join(TOKENIZERS, "byte_bpe_50k.json")
WORD_BPE = os.path.join(TOKENIZERS, "word_bpe_49k.json")

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(build):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


@query
def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and digest of the base spans, all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)

    def count(kind: str):
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secrets.written(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.written(F.col("secret_spans")).alias("spans"),
    )


# The rules the query applies, and host labels that mark junk sites.
URL_RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
JUNK_HOST = r"(^|[.-])(pills|bets|casino|adult|xxx|porn|warez|loans)([.-]|$)"


def url_list(pages: DataFrame) -> DataFrame:
    """The rules, and the canonical URLs of pages on junk sites."""
    rules = pages.sparkSession.createDataFrame(
        [("rule", h, p, a) for h, p, a in URL_RULES], "kind string, host string, path string, action string"
    )
    host, path = url_filter.host_and_path(F.col("url"))
    junk = (
        pages.select("url", host.alias("host"), path.alias("path"))
        .where(F.col("host").rlike(JUNK_HOST))
        .select(
            F.lit("url").alias("kind"),
            url_filter.canonical(F.col("url"), F.col("host"), F.col("path")).alias("host"),
            F.lit("").alias("path"),
            F.lit("block").alias("action"),
        )
        .distinct()
    )
    return rules.unionByName(junk)


@query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, deciding rule and verdict of every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_filter.judge(pages, url_list(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


ORACLES["op2_url_filter"] = r"""
WITH raw AS (
  SELECT page_id, url,
         CASE WHEN position('://' IN url) > 0
              THEN substr(url, position('://' IN url) + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id, url,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1),
           '^[^?#]*', 0), '') AS path
  FROM raw),
keyed AS (
  SELECT *,
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m)[.]', '')
    || regexp_replace(path, '/$', '')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(
         string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'),
         lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))),
         '&'), ''), '') AS key
  FROM parts),
junk AS (
  SELECT DISTINCT key FROM keyed WHERE regexp_matches(host,
    '(^|[.-])(pills|bets|casino|adult|xxx|porn|warez|loans)([.-]|$)')),
rules(rule_host, rule_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT k.page_id, k.url, k.host, k.path, k.key,
         max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         max_by(action, length(rule_host || rule_path)) AS action
  FROM (SELECT row_number() OVER () AS row, * FROM keyed) k
  LEFT JOIN rules r ON (k.host = r.rule_host OR ends_with(k.host, '.' || r.rule_host))
                   AND starts_with(k.path, r.rule_path)
  GROUP BY k.row, k.page_id, k.url, k.host, k.path, k.key)
SELECT page_id, host, path, rule,
       coalesce(action, CASE WHEN (host <> '' OR path <> '') AND key IN (SELECT key FROM junk)
                             THEN 'block' END, 'allow') AS verdict
FROM best
"""


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from those outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language.held_out(F.col("doc_id"), 3, 1)
    model = language.train(docs.where(~held))
    found = language.predict(docs.select("doc_id", "text"), model, spans=False, keep_text=False)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_rules.apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "kept_chars",
    )


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from positives outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held = language.held_out(F.col("doc_id"), 4, 2)
    model = quality_pu.train(docs.where(~held), labels.where(~held & (F.col("quality") == 1)))
    return quality_pu.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_dp.encode(docs, BYTE_BPE, decoded=True, keep_text=False)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids, one row per piece."""
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written to flat files; one row per document, read from them."""
    folder = shared_folder(spark, "tokens")
    parts = token_files.write(table(spark, sf_dir, "documents"), folder, WORD_BPE)
    return token_files.read(spark, folder, parts)


@query
def op10_ann_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of all vectors for every fiftieth."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann_collisions.search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


@query
def op7_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and component of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_groups.join(docs).select("doc_id", "n_shingles", "component_id")


@query
def op11_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of every document in a mix of all sources, weighed 5, 2, 1 in turn."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pareto_mix.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op11_pareto_mix"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS row, doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         (CAST('0x' || substr(md5('row:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(source, '-')
           || ':' || coalesce(md5(text), '-') || ':0'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
weighed AS (
  SELECT source, source_size, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source)),
stops AS (
  SELECT *, 2 * source_size / weight::DOUBLE AS ratio, row_number() OVER w AS stopped,
         sum(weight) OVER () - sum(weight) OVER w AS free, 2 * sum(source_size) OVER w AS fixed,
         1.5::DOUBLE * sum(source_size) OVER () AS share, lead(2 * source_size / weight::DOUBLE) OVER (ORDER BY 2 * source_size / weight::DOUBLE, source) AS next
  FROM weighed WINDOW w AS (ORDER BY 2 * source_size / weight::DOUBLE, source)),
levels AS (
  SELECT 0 AS stopped, max(share) / sum(weight)::DOUBLE AS level, min(ratio) AS next FROM stops
  UNION ALL SELECT stopped, (share - fixed) / free::DOUBLE, next FROM stops WHERE free > 0),
level AS (SELECT arg_min(level, stopped) AS level FROM levels WHERE level <= next),
goals AS (SELECT source, source_size, least(level * weight, 2 * source_size::DOUBLE) AS target FROM weighed, level),
wanted AS (
  SELECT d.*, g.source_size, g.target,
         CASE WHEN size > 0 THEN target / g.source_size::DOUBLE ELSE 0 END AS expected,
         CASE WHEN size > 0 THEN 4 * (length(bin(size)) - 1) + (size * 4) // (1 << (length(bin(size)) - 1)) - 4 ELSE -1 END AS class
  FROM docs d JOIN goals g ON g.source IS NOT DISTINCT FROM d.source),
drawn AS (
  SELECT *, CAST(floor(expected) AS BIGINT) AS whole, CAST(floor((expected - floor(expected)) * 1000000000) AS BIGINT) AS units FROM wanted),
classes AS (
  SELECT source, class, count(*) AS documents, sum(units)::DOUBLE AS units, sum(units * size)::DOUBLE AS words,
         row_number() OVER (PARTITION BY source ORDER BY class DESC) AS step,
         (CAST('0x' || substr(md5('class:' || coalesce(source, '-') || ':' || CAST(class AS VARCHAR) || ':0'), 1, 13) AS BIGINT)
           + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM drawn WHERE units > 0 GROUP BY source, class),
down AS (
  SELECT source, CAST(0 AS BIGINT) AS step, CAST(-2 AS BIGINT) AS class, 0::DOUBLE AS owed, CAST(0 AS BIGINT) AS n FROM goals
  UNION ALL
  SELECT source, step, class, owed + words / 1000000000::DOUBLE - n * (words / units), n
  FROM (SELECT c.source, c.step, CAST(c.class AS BIGINT) AS class, d.owed, c.words, c.units, CAST(least(c.documents, greatest(0,
               floor((c.words / 1000000000::DOUBLE + d.owed) / (c.words / c.units) + c.u))) AS BIGINT) AS n
        FROM down d JOIN classes c ON c.source IS NOT DISTINCT FROM d.source AND c.step = d.step + 1)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source, class ORDER BY CASE WHEN units > 0
    THEN (u / (1 - u)) / ((units / 1000000000::DOUBLE) / (1 - units / 1000000000::DOUBLE)) ELSE 'inf'::DOUBLE END, size) - 1 AS place
  FROM drawn)
SELECT p.doc_id, p.size, p.source_size, p.target,
       CAST(p.size * (p.whole + CASE WHEN p.place < d.n THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed p LEFT JOIN down d ON d.source IS NOT DISTINCT FROM p.source AND d.class = p.class
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty documents that rank highest for each benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical_search.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


ORACLES["op12_lexical_search"] = r"""
WITH words AS (
  SELECT row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS row, * FROM documents)),
counts AS (SELECT row, doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
docs AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY row),
totals AS (SELECT count(*) AS N_, CAST(sum(n) AS BIGINT) AS L_ FROM docs),
asked AS (
  SELECT item, item_id, term, count(*) AS q FROM (
    SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT row_number() OVER () AS item, * FROM benchmark))
  GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * N_ + 2) / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals),
scores AS (
  SELECT a.item, a.item_id, c.row, c.doc_id,
         CAST(sum(a.q * x.w * ((1000000000 * c.tf) // (1000 * c.tf + 12 * (100 - 25 + (25 * d.n * N_) // L_)))) AS BIGINT) AS score
  FROM asked a JOIN counts c USING (term) JOIN weights x USING (term) JOIN docs d USING (row), totals GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
WHERE rank <= 20
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, roots and proof, and whether it still verifies where every line break
    of half of the texts is deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    text = F.col("text")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & text.contains("\n")
    shown = F.when(changed, merkle.digest_of(*rest, F.replace(text, F.lit("\n"), F.lit(""))))
    proved = merkle.prove(docs, merkle.digest_of(*rest, text), shown)
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS k,
         list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
           lambda i: [ascii(substr(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END) % 2 AS odd,
         list_aggregate(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
           lambda v: coalesce(CAST(strlen(v) AS VARCHAR) || ':' || v, '-')), 'string_agg', '') AS head, text
  FROM documents),
leaves AS (
  SELECT doc_id, k, sha256(head || coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-')) AS h,
         CASE WHEN odd = 1 AND text IS NOT NULL THEN sha256(head || CAST(strlen(replace(text, chr(10), '')) AS VARCHAR) || ':' || replace(text, chr(10), '')) END AS shown
  FROM docs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM leaves),
lower_(k, level, i, h, n) AS (
  SELECT k, 0, i, h, n FROM placed
  UNION ALL SELECT k, level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM lower_ WHERE n > 1 GROUP BY k, level, i // 3, n),
subroots AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS t, count(*) OVER () AS n FROM lower_ WHERE n = 1),
upper_(level, i, h, n) AS (
  SELECT 0, t, h, n FROM subroots
  UNION ALL SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM upper_ WHERE n > 1 GROUP BY level, i // 3, n),
nodes AS (
  SELECT k, level, i, h, n FROM lower_
  UNION ALL SELECT s.k, 1000 + u.level, u.i, u.h, u.n FROM upper_ u, subroots s),
path AS (
  SELECT p.doc_id, p.k, p.i AS leaf_at, x.level,
         CASE WHEN x.level < 1000 THEN p.i // CAST(pow(3, x.level) AS BIGINT) ELSE s.t // CAST(pow(3, x.level - 1000) AS BIGINT) END AS at
  FROM placed p JOIN subroots s USING (k) JOIN (SELECT DISTINCT k, level FROM nodes WHERE n > 1) x USING (k)),
steps AS (
  SELECT p.k, p.leaf_at, p.level, coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < p.at), '') AS before,
         coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > p.at), '') AS after
  FROM path p JOIN nodes s ON s.k = p.k AND s.level = p.level AND s.i // 3 = p.at // 3 GROUP BY ALL),
proofs AS (
  SELECT k, leaf_at, string_agg(before || after, '' ORDER BY level) AS proof, list(before || '|' || after ORDER BY level) AS steps FROM steps GROUP BY ALL)
SELECT p.doc_id, p.h AS leaf, s.h AS subroot, r.h AS root, sha256(coalesce(q.proof, '')) AS proof_sha256,
       list_reduce(list_prepend(coalesce(p.shown, p.h), coalesce(q.steps, [])),
         lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root,
       folded_root = root AS verified
FROM placed p JOIN subroots s USING (k) JOIN (SELECT h FROM upper_ WHERE n = 1) r ON true
LEFT JOIN proofs q ON q.k = p.k AND q.leaf_at = p.i
"""
