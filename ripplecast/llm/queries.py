"""The registered query of each corpus operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, decontam, linededup, periods, phrases, pieces, quality, sharding, simhash, substring, tokenfiles, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, radius=3)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"), alpha=1.0, seed=0, digest=True, cache_nodes=900_000, at_once=400)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, _table(spark, sf_dir, "benchmark"), ["doc_id"], length=10)
    return found.select(
        "doc_id",
        "found.n_words",
        "found.n_hit",
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("found.items"), ","), 256).alias("items_sha256"),
        "found.contaminated",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = linededup.drop_recurring_lines(docs, min_docs=3, lead=3, similarity=0.8)
    return kept.select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))


OP4_SQL = r"""
WITH RECURSIVE raw AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
cut AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM raw),
plain AS (SELECT doc_id, line_no, trim(line, concat(' ', chr(9), chr(13))) AS plain FROM cut),
masked AS (
  SELECT doc_id, line_no, CASE WHEN regexp_replace(m, '<\*>| ', '', 'g') = '' THEN plain ELSE m END AS masked
  FROM (SELECT *, regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g') AS m FROM plain WHERE plain <> '')),
lines AS (
  SELECT *, len(string_split(masked, ' ')) AS n_tokens, concat_ws(' ', len(string_split(masked, ' ')), array_to_string(string_split(masked, ' ')[1:3], ' ')) AS leaf FROM masked),
uniq AS (SELECT leaf, masked, count(*) AS n FROM lines GROUP BY ALL),
crowded AS (SELECT * FROM uniq WHERE leaf IN (SELECT leaf FROM uniq GROUP BY leaf HAVING count(*) > 1)),
tok AS (SELECT leaf, n, unnest(string_split(masked, ' ')) AS token, unnest(range(len(string_split(masked, ' ')))) AS place FROM crowded),
votes AS (SELECT leaf, place, token, sum(n) AS votes FROM tok GROUP BY ALL),
winner AS (SELECT leaf, place, token FROM votes QUALIFY row_number() OVER (PARTITION BY leaf, place ORDER BY votes DESC, token) = 1),
each_tok AS (SELECT leaf, masked, unnest(string_split(masked, ' ')) AS token, unnest(range(len(string_split(masked, ' ')))) AS place FROM crowded),
alike AS (
  SELECT e.leaf, e.masked, count(*) FILTER (WHERE e.token = w.token) AS same, count(*) AS n
  FROM each_tok e JOIN winner w USING (leaf, place) GROUP BY ALL),
apart AS (SELECT leaf, masked, string_split(masked, ' ') AS w FROM alike WHERE same < 0.8 * n),
linked AS (
  SELECT a.leaf, a.masked AS a, b.masked AS b FROM apart a JOIN apart b ON a.leaf = b.leaf AND a.masked <> b.masked
  WHERE len(list_filter(range(1, len(a.w) + 1), lambda i: a.w[i] = b.w[i])) >= 0.8 * len(a.w)),
reach AS (SELECT leaf, a, a AS b FROM linked UNION SELECT r.leaf, r.a, l.b FROM reach r JOIN linked l ON l.leaf = r.leaf AND l.a = r.b),
grouped AS (SELECT leaf, a AS masked, min(b) AS root FROM reach GROUP BY ALL),
placed AS (
  SELECT doc_id, line_no, CASE WHEN same >= 0.8 * a.n THEN 'centre ' || leaf WHEN root IS NOT NULL THEN 'group ' || leaf || ' ' || root ELSE 'line ' || masked END AS template
  FROM lines l LEFT JOIN alike a USING (leaf, masked) LEFT JOIN grouped g USING (leaf, masked)),
common AS (
  SELECT template, min((doc_id, line_no)) AS first FROM placed GROUP BY template HAVING count(DISTINCT doc_id) >= 3),
gone AS (SELECT DISTINCT doc_id, line_no FROM placed JOIN common USING (template) WHERE (doc_id, line_no) <> first),
kept AS (
  SELECT doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM cut LEFT JOIN (SELECT *, true AS out FROM gone) USING (doc_id, line_no) WHERE out IS NULL GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(n_lines, 1) END AS n_lines,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(k.text, '')) END AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_table(spark, sf_dir, "documents"), window=20, digest=True)


#: Captures derived from pages: the page itself, then one to three later visits of its URL, by turns
#: a 304 with its validators right, wrong or absent, and a full response.
CAPTURES = """
SELECT page_id * 4 + visit AS record_id, url, visit,
  timestamp_micros(1704067200000000 + ((page_id * 7919) % 86400) * 1000000 + visit * 90000000000) AS ts,
  CASE WHEN visit > 0 AND (page_id + visit) % 4 <> 0 THEN 'revisit' ELSE 'response' END AS kind,
  CASE WHEN visit > 0 AND (page_id + visit) % 4 <> 0 THEN 304 ELSE 200 END AS status,
  md5(CASE WHEN (page_id + visit) % 5 = 0 THEN concat('x', html) ELSE html END) AS tag, html, page_id
FROM (SELECT page_id, url, html, explode(sequence(0, CAST(page_id % 4 AS INT))) AS visit FROM pages)
"""


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(CAPTURES.replace("FROM pages", "FROM {pages}"), pages=_table(spark, sf_dir, "pages"))
    tag = F.when(F.col("page_id") % 7 != 0, F.concat(F.when(F.col("visit") % 2 == 1, F.lit("W/")).otherwise(F.lit("")), F.lit('"'), "tag", F.lit('"')))
    date = F.when(F.col("page_id") % 14 != 0, F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string")))
    full = F.col("kind") == "response"
    said = F.create_map(
        F.lit("etag"), tag, F.lit("last-modified"), date, F.lit("date"), F.concat(F.lit("visit "), F.col("visit").cast("string")),
        F.lit("content-length"), F.when(full, F.length("html").cast("string")).otherwise(F.lit("0")),
        F.lit("content-type"), F.when(full, F.lit("text/html")), F.lit("x-cache"), F.when(~full, F.lit("hit")),
    )
    return rows.select(
        "record_id", "url", "ts", "kind", "status",
        F.map_filter(said, lambda _, v: v.isNotNull()).alias("headers"),
        F.when(full, F.sha2("html", 256)).alias("payload_sha256"),
        F.when(full, F.octet_length("html").cast("long")).alias("payload_bytes"),
    )


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve_revisits(captures(spark, sf_dir), ("payload_sha256", "payload_bytes"))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return found.select("record_id", "canonical_url", "matched_id", "outcome", F.array_join(lines, "; ").alias("headers"), "payload_sha256", "payload_bytes")


OP6_SQL = r"""
WITH visits AS (SELECT page_id, url, html, unnest(range(page_id % 4 + 1)) AS visit FROM pages),
rec AS (
  SELECT page_id * 4 + visit AS record_id, page_id, visit, html, ((page_id * 7919) % 86400) + visit * 90000 AS at,
    visit > 0 AND (page_id + visit) % 4 <> 0 AS revisit,
    CASE WHEN page_id % 7 <> 0 THEN '"' || md5(CASE WHEN (page_id + visit) % 5 = 0 THEN 'x' || html ELSE html END) || '"' END AS tag,
    CASE WHEN page_id % 14 <> 0 THEN 'day ' || (page_id % 28) END AS day,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '')
      || regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)', 2), '/+$', '') AS place,
    array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)([^?#]*)(\?[^#]*)?', 3), '^\?', ''), '&'), lambda x: x <> '' AND NOT starts_with(x, 'utm_'))), '&') AS query
  FROM visits),
r AS (SELECT *, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM rec),
matched AS (
  SELECT v.*, s.record_id AS matched_id, s.tag AS s_tag, s.day AS s_day, s.html AS s_html
  FROM (SELECT * FROM r WHERE revisit) v LEFT JOIN (SELECT * FROM r WHERE NOT revisit) s ON s.canonical_url = v.canonical_url AND s.at < v.at
  QUALIFY row_number() OVER (PARTITION BY v.record_id ORDER BY s.at DESC NULLS LAST, s.record_id DESC) = 1),
judged AS (
  SELECT *, CASE WHEN matched_id IS NULL THEN 'missing' WHEN tag IS NOT NULL AND s_tag IS NOT NULL THEN CASE WHEN tag = s_tag THEN 'resolved' ELSE 'mismatch' END
    WHEN day IS NOT NULL AND s_day IS NOT NULL THEN CASE WHEN day = s_day THEN 'resolved' ELSE 'mismatch' END ELSE 'unconfirmed' END AS outcome
  FROM matched)
SELECT record_id, canonical_url, matched_id, outcome,
  array_to_string(list_sort(list_filter([
    'content-length: ' || CASE WHEN outcome = 'resolved' THEN length(s_html) ELSE 0 END,
    CASE WHEN outcome = 'resolved' THEN 'content-type: text/html' END,
    'date: visit ' || visit,
    'etag: ' || CASE WHEN tag IS NOT NULL THEN CASE WHEN visit % 2 = 1 THEN 'W/' ELSE '' END || tag WHEN outcome = 'resolved' THEN
      (SELECT CASE WHEN any_value(x.visit) % 2 = 1 THEN 'W/' ELSE '' END FROM r x WHERE x.record_id = matched_id) || s_tag END,
    'last-modified: ' || coalesce(day, CASE WHEN outcome = 'resolved' THEN s_day END),
    'x-cache: hit'], lambda x: x IS NOT NULL)), '; ') AS headers,
  CASE WHEN outcome = 'resolved' THEN sha256(s_html) END AS payload_sha256,
  CASE WHEN outcome = 'resolved' THEN strlen(s_html) END AS payload_bytes
FROM judged
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.3)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.with_checksums(tokenfiles.token_files(_table(spark, sf_dir, "documents")))


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(_table(spark, sf_dir, "documents"), shards=40)
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.remove_repeated_bytes(_table(spark, sf_dir, "documents"), length=400, digest=True)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.collapse_runs(periods.with_planted_runs(_table(spark, sf_dir, "documents")), min_length=6, min_repeats=4, digest=True)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"), least=100, longest=5, top=2000, absorbed=100)


OP13_SQL = r"""
WITH rows AS (
  SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM rows),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM starts, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)),
every AS (SELECT lang, phrase, m, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM every WHERE m > 1),
cuts AS (
  SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS fst, array_to_string(w[k + 1:m], ' ') AS rest
  FROM cand, (SELECT unnest(range(1, 5)) AS k) WHERE k < m),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts c JOIN every x ON x.lang = c.lang AND x.phrase = c.fst JOIN every y ON y.lang = c.lang AND y.phrase = c.rest JOIN total t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + z - 1], ' ') AS phrase, max(a) AS longer
  FROM cand, (SELECT unnest(range(1, 5)) AS s), (SELECT unnest(range(2, 5)) AS z) WHERE z < m AND s + z - 1 <= m GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))::BIGINT AS rank, phrase, a, l, r, n, score
FROM scored LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_warc_revisits": op6_warc_revisits,
    "op7_quality": op7_quality,
    "op8_top_k": op8_top_k,
    "op9_token_files": op9_token_files,
    "op10_kd_shards": op10_kd_shards,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op4_line_dedup": OP4_SQL, "op6_warc_revisits": OP6_SQL, "op13_collocations": OP13_SQL}
