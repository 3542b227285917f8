"""Registered queries of the numbered operators: thin wrappers over llm/.

Each reads its whole table and returns the columns of its contract. Fixed
here are only the folds, limits and seeds of those contracts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cartwheel.llm import (
    embedding_dedup, langid, minhash_dedup, mixing, packing, periodic_runs, personal_data, quality_rules,
    source_divergence, suffix_dedup, token_counts, toxicity, url_lists,
)
from cartwheel.llm.common import id_bucket, table, words

QueryFn = Callable[[SparkSession, str], DataFrame]

# --- 1: URL lists -----------------------------------------------------------

#: First day of the captures and of the lists derived from the pages.
EPOCH = "2024-01-01"


def _number(text) -> F.Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages have no fetch time: a day of a year, by a hash of the id."""
    day = (_number(F.col("page_id").cast("string")) % 365).cast("int")
    return pages.select("page_id", "url").withColumn("fetched_on", F.date_add(F.lit(EPOCH).cast("date"), day))


def page_list_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries derived from the hosts and paths of all pages."""
    sites = pages.select(url_lists.host_of(F.col("url")).alias("host"), url_lists.path_of(F.col("url"))[0].alias("segment")).where(
        F.col("host").isNotNull()).distinct()
    hosts = sites.select("host").distinct().withColumn("n", _number(F.col("host")))
    folders = sites.where(F.col("segment").isNotNull()).select(
        F.concat("host", F.lit("/"), "segment").alias("pattern")).withColumn("n", _number(F.col("pattern")))
    domains = hosts.select(F.substring_index("host", ".", -3).alias("pattern")).distinct().withColumn("n", _number(F.col("pattern")))

    def changes(rows, list_name, action, pattern, when, steps):
        step = F.explode(F.array(*[F.struct(F.lit(c).alias("change"), F.lit(d).alias("after")) for c, d in steps]))
        return rows.where(when).select(
            F.lit(list_name).alias("list_name"), F.lit(action).alias("action"), pattern.alias("pattern"), F.col("n"), step.alias("s")).select(
            "list_name", "action", "pattern", F.col("s.change").alias("change"),
            F.date_add(F.lit(EPOCH).cast("date"), (F.col("n") % 200 + F.col("s.after")).cast("int")).alias("changed_on"))

    return (changes(hosts, "abuse", "block", F.col("host"), F.col("n") % 3 == 0, [("add", 0), ("remove", 60), ("add", 120)])
            .unionByName(changes(domains, "spam", "block", F.col("pattern"), F.col("n") % 2 == 0, [("add", 10), ("remove", 90)]))
            .unionByName(changes(folders, "trusted", "allow", F.col("pattern"), F.col("n") % 5 < 2, [("add", 0), ("add", 30), ("remove", 150)])))


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    judged = url_lists.as_of_join(page_captures(pages), page_list_entries(pages))
    return judged.select("page_id", "fetched_on", "host", "verdict", "list_name", "pattern", "valid_from", "valid_to",
                         (F.coalesce(F.col("verdict"), F.lit("none")) != "block").alias("kept"))


OP1_SQL = r"""
WITH caps AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 8))::BIGINT % 365 AS INTEGER) AS fetched_on,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.+$', ''), '') AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
hosts AS (SELECT DISTINCT host AS pattern FROM caps WHERE host IS NOT NULL),
domains AS (SELECT DISTINCT array_to_string(string_split(pattern, '.')[-3:], '.') AS pattern FROM hosts),
folders AS (SELECT DISTINCT host || '/' || segs[1] AS pattern FROM caps WHERE host IS NOT NULL AND len(segs) > 0),
named AS (
  SELECT 'abuse' AS list_name, 'block' AS action, pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT AS n FROM hosts
  UNION ALL SELECT 'spam', 'block', pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT FROM domains
  UNION ALL SELECT 'trusted', 'allow', pattern, ('0x' || substr(md5(pattern), 1, 8))::BIGINT FROM folders),
steps(list_name, change, after) AS (VALUES ('abuse', 'add', 0), ('abuse', 'remove', 60), ('abuse', 'add', 120),
  ('spam', 'add', 10), ('spam', 'remove', 90), ('trusted', 'add', 0), ('trusted', 'add', 30), ('trusted', 'remove', 150)),
changes AS (
  SELECT n.list_name, n.action, n.pattern, s.change, DATE '2024-01-01' + CAST(n.n % 200 + s.after AS INTEGER) AS changed_on
  FROM named n JOIN steps s USING (list_name)
  WHERE (n.list_name = 'abuse' AND n % 3 = 0) OR (n.list_name = 'spam' AND n % 2 = 0) OR (n.list_name = 'trusted' AND n % 5 < 2)),
spans AS (
  SELECT * FROM (SELECT list_name, action, pattern, change, changed_on AS valid_from,
      coalesce(lead(changed_on) OVER (PARTITION BY list_name, action, pattern ORDER BY changed_on), DATE '9999-12-31') AS valid_to FROM changes)
  WHERE change = 'add'),
parts AS (
  SELECT *, string_split(pattern, '/')[1] AS p_host, list_filter(string_split(pattern, '/')[2:], lambda s: s <> '') AS p_segs FROM spans),
hits AS (
  SELECT c.page_id, p.*, row_number() OVER (PARTITION BY c.page_id ORDER BY len(string_split(p_host, '.')) DESC, len(p_segs) DESC, action, list_name, pattern, valid_from) AS k
  FROM caps c JOIN parts p ON (c.host = p_host OR ends_with(c.host, '.' || p_host)) AND (len(p_segs) = 0 OR c.segs[1:len(p_segs)] = p_segs)
   AND valid_from <= c.fetched_on AND c.fetched_on < valid_to)
SELECT c.page_id, c.fetched_on, c.host, h.action AS verdict, h.list_name, h.pattern, h.valid_from, h.valid_to,
  coalesce(h.action, 'none') <> 'block' AS kept
FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id AND h.k = 1
"""

# --- 2: token counts --------------------------------------------------------


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


# --- 3: near-duplicates -----------------------------------------------------


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


# --- 4: repeated substrings -------------------------------------------------


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


# --- 5: toxicity ------------------------------------------------------------


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), id_bucket(F.col("doc_id"), 4) != 2)
    return toxicity.score(docs, model).select(
        "doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


# --- 6: embeddings ----------------------------------------------------------


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


# --- 7: quality rules -------------------------------------------------------


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, text, ws, list_transform(range(1, greatest(len(ws) - 1, 1)), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS tri FROM w),
e AS (SELECT doc_id, unnest(tri) AS t, unnest(range(1, len(tri) + 1)) AS i FROM g),
d AS (SELECT doc_id, t FROM e GROUP BY doc_id, t HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
  SELECT e.doc_id, unnest([e.i, e.i + 1, e.i + 2]) AS p FROM e JOIN d ON e.doc_id = d.doc_id AND e.t = d.t) GROUP BY doc_id),
m AS (SELECT doc_id, text, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls, len(string_split(text, chr(10))) AS lines FROM g),
b AS (SELECT m.*, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters,
  len(regexp_extract_all(text, '(\.\.\.|…)[ \t\r]*(?:\n|$)')) AS ellipses FROM m LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > 30 * greatest(n_words, 1) OR word_chars < 2 * greatest(n_words, 1) OR 10 * n_symbols > greatest(n_words, 1)
    OR 10 * n_dup_lines > 3 * lines OR 5 * n_repeat_words > 2 * greatest(n_words, 1) OR 10 * letters < 6 * greatest(word_chars, 1)
    OR 10 * ellipses > 3 * lines) AS kept
FROM f
"""

# --- 8: mixing --------------------------------------------------------------


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1]::BIGINT AS w
  FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () AS total, row_number() OVER (ORDER BY source_size * (6 // w), source) AS k FROM s),
c AS (SELECT *, coalesce(sum(source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM o),
l AS (SELECT 3 * total - 4 * before AS num, 2 * open_w AS den FROM c WHERE (3 * total - 4 * before) * w <= 4 * open_w * source_size ORDER BY k LIMIT 1),
t AS (SELECT s.*, CASE WHEN l.num * s.w > 2 * s.source_size * l.den THEN CAST(2 * s.source_size AS DOUBLE)
  ELSE CAST(l.num AS DOUBLE) * s.w / CAST(l.den AS DOUBLE) END AS target FROM s, l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN
  ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix'), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM r
"""

# --- 9: language ------------------------------------------------------------


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, id_bucket(F.col("doc_id"), 3) != 1)
    return langid.predict(docs, model).select(
        "doc_id", (id_bucket(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


# --- 10: packing ------------------------------------------------------------


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


# --- 11: periodic runs ------------------------------------------------------


def periodic_texts(docs: DataFrame) -> DataFrame:
    """The contract's texts (doc_id, text): with h the crc32 of the id and g its
    tenth, the words from a = g % n on of one document in ten repeat with period
    1 + (n - a) / (3 + g % 8). A null id counts as ''."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    i = F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)
    place = F.transform(i, lambda k: F.when(k < F.col("_a"), k).otherwise(F.col("_a") + (k - F.col("_a")) % F.col("_p")))
    g = F.floor(F.col("_h") / 10)
    return (docs.select("doc_id", "text", h.alias("_h"))
            .withColumn("_w", F.when(F.col("_h") % 10 == 0, words(F.col("text"))))  # null: the text stays
            .withColumn("_n", F.size("_w").cast("long"))
            .withColumn("_a", F.when(F.col("_n") > 0, g % F.col("_n")))
            .withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("long"))
            .withColumn("_text", F.when(F.col("_n") > 0, F.array_join(F.transform(place, lambda k: F.get(F.col("_w"), k.cast("int"))), " ")))
            .select("doc_id", F.coalesce("_text", "text").alias("text")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_texts(table(spark, sf_dir, "documents")))
    # the longest run: least of (-length, start, period)
    order = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("_top", order).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_top.s").alias("start"), (-F.col("_top.n")).alias("length"),
        F.col("_top.p").alias("period"), F.floor(-1000 * F.col("_top.n") / F.col("_top.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


# --- 12: source divergence --------------------------------------------------


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= 30),
l AS (SELECT lang, count(*) AS v, sum(lang_n) AS n FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
dense AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.lang_n, l.v, l.n AS lang_total,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v)::HUGEINT AS q FROM dense),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
  WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
rows_of AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows_of)
WHERE part = 'pair' OR rank <= 50
"""
# --- 13: personal data ------------------------------------------------------


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, personal_data.BASE_KINDS), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


QUERIES: dict[str, QueryFn] = {
    "op1_url_lists": op1_url_lists,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_mixing": op8_mixing,
    "op9_language": op9_language,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_source_divergence": op12_source_divergence,
    "op13_personal_data": op13_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_lists": OP1_SQL,
    "op7_quality_rules": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op12_source_divergence": OP12_SQL,
}
