"""The subpackage's queries: op1 to op10 over their whole tables, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontam, exact_dedup, html_main, jaccard_join, licenses, packing, quality, secrets, toxicity, url_lists
from lodestrata.llm.runtime import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.extract_main(pages, html_main.learn(pages))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for hosts, domains and prefixes of pages, by a rule on the MD5 of the pattern.

    The pages come without lists, so the query makes its own, which grow with the hosts: (list, scope, pattern, action, at).
    """
    host, path = url_lists.host_of(F.col("url")), url_lists.path_of(F.col("url"))
    hosts = pages.select(host.alias("h"), F.split_part(path, F.lit("/"), F.lit(2)).alias("s")).filter("h <> ''").distinct()
    patterns = (
        hosts.select(F.lit("host").alias("scope"), F.col("h").alias("pattern"))
        .union(hosts.select(F.lit("domain"), F.regexp_extract("h", r"([^.]+\.[^.]+\.[^.]+)$", 1))).filter("pattern <> ''")
        .union(hosts.filter("s <> ''").select(F.lit("prefix"), F.concat("h", F.lit("/"), "s", F.lit("/"))))
        .distinct()
    )
    m = F.md5(F.concat_ws(":", "scope", "pattern").cast("binary"))
    digit = lambda i: F.ascii(F.substring(m, i, 1))  # noqa: E731
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))  # noqa: E731
    named = patterns.filter(digit(1) < 53).withColumn("list", F.when(digit(2) < 53, "spam").when(digit(2) < 98, "adult").otherwise("malware"))
    first, second, third = (digit(3) * 7) % 200, (digit(3) * 7) % 200 + digit(4) % 90 + 1, (digit(3) * 7) % 200 + digit(4) % 90 + 40
    add = named.select("list", "scope", "pattern", F.lit("add").alias("action"), day(first).alias("at"))
    gone = named.filter(digit(5) < 56).select("list", "scope", "pattern", F.lit("remove"), day(second))
    back = named.filter((digit(5) < 56) & (digit(6) < 52)).select("list", "scope", "pattern", F.lit("add"), day(third))
    return add.union(gone).union(back)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of pages; fetched is a day of 2024 given by page_id, which the table lacks."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched"))
    return url_lists.evaluate(captures, list_entries(pages.select("url")))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, regexp_replace(regexp_extract(lower(trim(coalesce(url, ''))), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', '') AS host,
    regexp_extract(trim(coalesce(url, '')), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1) AS path,
    DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched
  FROM pages
), hosts AS (SELECT DISTINCT host AS h, split_part(path, '/', 2) AS s FROM p WHERE host <> ''),
patterns AS (
  SELECT 'host' AS scope, h AS pattern FROM hosts
  UNION SELECT 'domain', regexp_extract(h, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM hosts WHERE regexp_extract(h, '([^.]+\.[^.]+\.[^.]+)$', 1) <> ''
  UNION SELECT 'prefix', h || '/' || s || '/' FROM hosts WHERE s <> ''
), m AS (SELECT scope, pattern, md5(scope || ':' || pattern) AS m FROM patterns),
d AS (SELECT scope, lower(pattern) AS pattern, [ascii(substr(m, i, 1)) FOR i IN [1, 2, 3, 4, 5, 6]] AS g FROM m),
n AS (SELECT scope, pattern, CASE WHEN g[2] < 53 THEN 'spam' WHEN g[2] < 98 THEN 'adult' ELSE 'malware' END AS list, g, (g[3] * 7) % 200 AS f FROM d WHERE g[1] < 53),
e AS (
  SELECT list, scope, pattern, 'add' AS action, DATE '2024-01-01' + CAST(f AS INTEGER) AS dt FROM n
  UNION ALL SELECT list, scope, pattern, 'remove', DATE '2024-01-01' + CAST(f + g[4] % 90 + 1 AS INTEGER) FROM n WHERE g[5] < 56
  UNION ALL SELECT list, scope, pattern, 'add', DATE '2024-01-01' + CAST(f + g[4] % 90 + 40 AS INTEGER) FROM n WHERE g[5] < 56 AND g[6] < 52
), days AS (SELECT list, scope, pattern, dt, max(action) AS action FROM e GROUP BY ALL),
c AS (SELECT * FROM (SELECT *, coalesce(lag(action) OVER w, 'remove') AS was FROM days WINDOW w AS (PARTITION BY list, scope, pattern ORDER BY dt)) WHERE was <> action),
i AS (SELECT * FROM (SELECT list, scope, pattern, action, dt AS valid_from, lead(dt) OVER (PARTITION BY list, scope, pattern ORDER BY dt) AS valid_to FROM c) WHERE action = 'add'),
caps AS (SELECT page_id, host, path, fetched, count(*) AS n_captures FROM p GROUP BY ALL),
labels AS (SELECT *, string_split(host, '.') AS l, string_split(path, '/') AS s FROM caps),
keyed AS (
  SELECT page_id, host, path, fetched, 'host' AS scope, host AS pattern FROM labels WHERE host <> ''
  UNION SELECT page_id, host, path, fetched, 'domain', array_to_string(l[k:], '.') FROM (SELECT *, unnest(range(1, len(l))) AS k FROM labels WHERE host <> '' AND len(l) >= 2)
  UNION SELECT page_id, host, path, fetched, 'prefix', host || array_to_string(s[1:k], '/') || '/' FROM (SELECT *, unnest(range(1, greatest(len(s) - 1, 1) + 1)) AS k FROM labels WHERE host <> '')
), hits AS (
  SELECT k.page_id, k.host, k.path, k.fetched, count(*) AS n_active, list_sort(list(DISTINCT i.list)) AS lists
  FROM keyed k JOIN i ON k.scope = i.scope AND k.pattern = i.pattern AND k.fetched >= i.valid_from AND (i.valid_to IS NULL OR k.fetched < i.valid_to) GROUP BY ALL
)
SELECT c.page_id, c.host, c.path, c.fetched, c.n_captures, coalesce(h.n_active, 0) AS n_active, coalesce(array_to_string(h.lists, ','), '') AS lists, coalesce(h.n_active, 0) > 0 AS blocked
FROM caps c LEFT JOIN hits h ON c.page_id IS NOT DISTINCT FROM h.page_id AND c.host = h.host AND c.path = h.path AND c.fetched IS NOT DISTINCT FROM h.fetched
"""


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents
), r AS (
  SELECT doc_id, n, first_value(doc_id) OVER (PARTITION BY n ORDER BY length(t) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY n) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n) AS text_sha256 FROM r
"""


_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"
OP8_SQL = f"""
WITH i AS (SELECT item_id, w, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
s AS (SELECT DISTINCT item_id, k, unnest([array_to_string(w[x:x + k - 1], ' ') FOR x IN range(1, len(w) - k + 2)]) AS sh FROM i),
n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY 1),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, k, unnest([array_to_string(w[x:x + k - 1], ' ') FOR x IN range(1, len(w) - k + 2)]) AS sh FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k),
c AS (SELECT doc_id, item_id, count(*) AS shared_shingles FROM s JOIN g USING (k, sh) GROUP BY ALL)
SELECT doc_id, item_id, item_shingles, shared_shingles, shared_shingles / item_shingles AS containment FROM c JOIN n USING (item_id) WHERE shared_shingles >= item_shingles * 0.8 - 1e-9
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[x:x + 3], ' ') FOR x IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
u AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS t FROM s),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = doc_id), doc_id)) AS component_id FROM s
"""


def queries() -> dict:
    own = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return own


def oracle_sql() -> dict:
    return {"op4_url_filter": OP4_SQL, "op8_decontamination": OP8_SQL, "op9_exact_dedup": OP9_SQL, "op10_jaccard_join": OP10_SQL}
