"""Named queries of the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as T
from lodestrata.plans.registry import register
from lodestrata.tables import load

_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@register("token_stats", f"SELECT lang, CAST(sum(len({_WORDS})) AS BIGINT) AS n_tokens, count(DISTINCT doc_id) AS n_docs, max(len({_WORDS})) AS longest FROM documents GROUP BY lang")
def token_stats(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", F.size(T.tokens(F.col("text"))).cast("long").alias("n"))
    return docs.groupBy("lang").agg(F.sum("n").alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs"), F.max("n").alias("longest"))


@register("fold_marks", f"SELECT doc_id, md5(translate(text, '{''.join(T.FOLD)}', '{''.join(T.FOLD.values())}')) AS folded FROM documents")
def fold_marks(spark, d):
    return load(spark, d, "documents").select("doc_id", F.md5(T.fold_marks(F.col("text")).cast("binary")).alias("folded"))


@register("fold_nfkc", "SELECT doc_id, md5(nfc_normalize(text) || ' H2O x2 a-b -5 um find A1 ' || (doc_id % 10)) AS folded FROM documents")
def fold_nfkc(spark, d):
    """Texts with compatibility characters, which the corpus lacks, after them."""
    signs = F.concat(F.lit(" H\u2082O x\u00b2 a\u2013b \u22125 \u00b5m \ufb01nd \uff21\u2460 "), (F.col("doc_id") % 10).cast("string"))
    return load(spark, d, "documents").select("doc_id", F.md5(T.fold(F.concat("text", signs)).cast("binary")).alias("folded"))


@register("clean_words", f"""
WITH w AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(trim(text), '\\s+'), lambda x: regexp_replace(x, '^[.,;:?!"''()\\[\\]{{}}<>`¿¡]+|[.,;:?!"''()\\[\\]{{}}<>`¿¡]+$', '', 'g')), lambda x: x <> '') AS a FROM documents),
k AS (SELECT doc_id, a, list_filter(a, lambda x: lower(x) NOT IN ({_STOP})) AS b FROM w)
SELECT doc_id, CAST(len(CASE WHEN len(b) > 0 THEN b ELSE a END) AS BIGINT) AS n_words, (CASE WHEN len(b) > 0 THEN b ELSE a END)[1] AS first_word FROM k""")
def clean_words(spark, d):
    w = load(spark, d, "documents").select("doc_id", T.clean_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.get("w", F.lit(0)).alias("first_word"))


_BASE = "CASE WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END"
_STEM = "CASE WHEN length(w) <= 3 THEN w " + " ".join(f"WHEN b LIKE '%{s}' AND length(b) - {len(s)} >= 3 THEN left(b, length(b) - {len(s)})" for s in T.SUFFIXES) + " ELSE b END"


@register("stem_counts", f"WITH t AS (SELECT unnest({_WORDS}) AS w FROM documents WHERE lang = 'en'), u AS (SELECT w, {_BASE} AS b FROM t) SELECT {_STEM} AS stem, count(*) AS n, count(DISTINCT w) AS n_forms FROM u GROUP BY 1")
def stem_counts(spark, d):
    words = load(spark, d, "documents").filter("lang = 'en'").select(F.explode(T.tokens(F.col("text"))).alias("w"))
    counted = words.groupBy("w").agg(F.count("*").alias("n"))
    return counted.groupBy(T.stem(F.col("w")).alias("stem")).agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


@register("display_titles", """
WITH w AS (SELECT p_partkey, string_split(replace(lower(p_name), ' ', '_') || '_of_nmr_data', '_') AS a FROM part)
SELECT p_partkey, array_to_string([CASE WHEN x IN ('nmr') THEN upper(x) WHEN x = 'of' THEN x ELSE upper(left(x, 1)) || substr(x, 2) END FOR x IN a], ' ') AS title FROM w""")
def display_titles(spark, d):
    s = F.concat(F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")), F.lit("_of_nmr_data"))
    return load(spark, d, "part").select("p_partkey", T.display_title(s).alias("title"))


@register("slug_keys", r"""
WITH s AS (SELECT DISTINCT trim(regexp_replace(lower(trim(p_type || ' ' || p_name || ' Methods')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part)
SELECT slug, regexp_replace(slug, '(_?(reactions|processes|techniques|technique|reaction|process|methods|method))+$', '') AS key FROM s""")
def slug_keys(spark, d):
    label = F.concat_ws(" ", "p_type", "p_name", F.lit("Methods"))
    return load(spark, d, "part").select(T.slug(label).alias("slug"), T.concept_key(label).alias("key")).distinct()


@register("scoped_keys", """
WITH s AS (SELECT DISTINCT lower(p_type) AS t, string_split(lower(p_name), ' ') AS a FROM part)
SELECT t AS parent, array_to_string(a, '_') AS leaf, array_to_string(list_filter(a, lambda x: x <> t), '_') AS scoped FROM s""")
def scoped_keys(spark, d):
    """Leaf labels without their parent's words; part names have neither plurals nor endings."""
    p = load(spark, d, "part").select(F.lower("p_type").alias("parent"), F.array_join(F.split(F.lower("p_name"), " "), "_").alias("leaf")).distinct()
    return p.select("parent", "leaf", T.scoped_key(F.array("parent", "leaf")).alias("scoped"))


@register("label_identity_guard", """
WITH l AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS a FROM part)
SELECT x.a AS left_label, y.a AS right_label, x.a = y.a AS compatible FROM l x JOIN l y ON x.a <= y.a""")
def label_identity_guard(spark, d):
    """Every first word of a part name stands for an entity of its own: only equal ones may merge."""
    words = load(spark, d, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a")).distinct()
    table = {r["a"]: r["a"] for r in words.collect()}  # the first words of names: a vocabulary, not data
    pairs = words.select(F.col("a").alias("left_label")).join(words.select(F.col("a").alias("right_label")), F.col("left_label") <= F.col("right_label"))
    return pairs.withColumn("compatible", T.compatible(F.col("left_label"), F.col("right_label"), table))


@register("doi_extraction", r"""
WITH m AS (SELECT doc_id, '10.' || (1000 + doc_id % 9000) || '/' || source AS doi FROM documents),
t AS (SELECT doc_id, 'see https://doi.org/' || upper(doi) || '. and DOI: ' || doi || ',' AS x FROM m)
SELECT doc_id, list_distinct([rtrim(lower(y), '.,;)') FOR y IN regexp_extract_all(x, '10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+')])[1] AS doi, CAST(len(list_distinct([rtrim(lower(y), '.,;)') FOR y IN regexp_extract_all(x, '10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+')])) AS BIGINT) AS n FROM t""")
def doi_extraction(spark, d):
    doi = F.concat(F.lit("10."), (1000 + F.col("doc_id") % 9000).cast("string"), F.lit("/"), F.col("source"))
    text = F.concat(F.lit("see https://doi.org/"), F.upper(doi), F.lit(". and DOI: "), doi, F.lit(","))
    found = load(spark, d, "documents").select("doc_id", T.dois(text).alias("f"))
    return found.select("doc_id", F.get("f", F.lit(0)).alias("doi"), F.size("f").cast("long").alias("n"))


@register("sentence_split", r"""
WITH s AS (SELECT doc_id, unnest(list_filter([trim(x) FOR x IN regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+')], lambda x: x <> '')) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, CAST(max(length(s)) AS BIGINT) AS longest FROM s GROUP BY doc_id""")
def sentence_split(spark, d):
    s = load(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.filter(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@register("section_split", """
SELECT conv_id, count(*) AS n_sections, CAST(sum(length(trim(text, ' '))) AS BIGINT) AS n_chars FROM (SELECT conv_id, turn, regexp_replace(text, '#', '', 'g') AS text FROM conversations) WHERE trim(text) <> '' OR true GROUP BY conv_id""")
def section_split(spark, d):
    """Each conversation as one text with a heading for every turn, split again."""
    turns = load(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("# turn "), F.col("turn").cast("string"), F.lit("\n"), F.trim(F.regexp_replace("text", "#", ""))).alias("t"))
    text = turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]), "\n").alias("text"))
    s = text.select("conv_id", F.explode(T.sections(F.col("text"))).alias("s"))
    return s.groupBy("conv_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("s.body")).alias("n_chars"))


@register("quantity_counts", r"""
WITH t AS (SELECT l_orderkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) || ' mg at ' || CAST(l_linenumber AS VARCHAR) || '%' AS x FROM lineitem)
SELECT l_orderkey, CAST(sum(len(regexp_extract_all(x, '[0-9]+ ?(mg|g)')) + len(regexp_extract_all(x, '[0-9]+ ?%'))) AS BIGINT) AS n FROM t GROUP BY 1""")
def quantity_counts(spark, d):
    x = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" mg at "), F.col("l_linenumber").cast("string"), F.lit("%"))
    return load(spark, d, "lineitem").select("l_orderkey", T.quantity_count(x).alias("n")).groupBy("l_orderkey").agg(F.sum("n").cast("long").alias("n"))


@register("html_to_text", r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s]+', ' ', 'g'), ' ')) AS text_md5 FROM pages")
def html_to_text(spark, d):
    return load(spark, d, "pages").select("page_id", F.md5(T.strip_markup(F.col("html")).cast("binary")).alias("text_md5"))


@register("url_canonical", r"""
WITH u AS (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '^https?://(www\.|m\.)?', '') AS u FROM pages)
SELECT rtrim(u, '/') AS canonical, count(*) AS n, min(page_id) AS first_page FROM u GROUP BY 1""")
def url_canonical(spark, d):
    u = F.regexp_replace(F.regexp_replace(F.lower("url"), r"[?#].*$", ""), r"^https?://(www\.|m\.)?", "")
    return load(spark, d, "pages").groupBy(F.regexp_replace(u, "/+$", "").alias("canonical")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@register("author_lists", """
WITH a AS (SELECT l_orderkey, list_sort(list(DISTINCT 'Supplier  ' || l_suppkey)) AS n FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(len(n) AS BIGINT) AS n_authors, replace(n[1], '  ', ' ') AS first_author FROM a""")
def author_lists(spark, d):
    raw = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_set(F.concat(F.lit("Supplier  "), F.col("l_suppkey").cast("string"))))).alias("raw"))
    names = raw.select("l_orderkey", T.author_list(F.col("raw")).alias("n"))
    return names.select("l_orderkey", F.size("n").cast("long").alias("n_authors"), F.get("n", F.lit(0)).alias("first_author"))


@register("loose_numbers", """
SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE value END AS number FROM events""")
def loose_numbers(spark, d):
    v = F.col("value").cast("string")
    k = F.col("event_id") % 4
    raw = F.when(k == 0, v).when(k == 1, F.concat(F.lit(" "), v, F.lit("% "))).when(k == 2, F.concat(v, F.lit("%"))).otherwise("n/a")
    return load(spark, d, "events").select("event_id", T.loose_number(raw).alias("number"))


@register("first_strings", "SELECT event_id, event_type AS first FROM events")
def first_strings(spark, d):
    k = F.col("event_id") % 3
    raw = F.when(k == 0, F.col("event_type")).when(k == 1, F.to_json(F.array("event_type", F.lit("x")))).otherwise(F.to_json(F.struct("event_type")))
    return load(spark, d, "events").select("event_id", T.first_string(raw).alias("first"))


@register("snippets", "SELECT doc_id, substr(text, 1, 200) AS snippet, md5(substr(text, 1, 500)) AS long_md5 FROM documents")
def snippets(spark, d):
    return load(spark, d, "documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"), F.md5(T.snippet(F.col("text"), 500).cast("binary")).alias("long_md5"))


@register("searchable_texts", "SELECT p_partkey, concat_ws(' ', p_name, p_brand, p_type, 'x', p_brand) AS text FROM part")
def searchable_texts(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", T.searchable_text([F.col("p_name"), F.col("p_brand"), F.lit(None).cast("string")], [F.array("p_type", F.lit("x"))], [F.create_map(F.lit("b"), F.col("p_brand"))]).alias("text"))


@register("paper_texts", """
WITH g AS (SELECT source, list_sort(list(DISTINCT lang))[1:30] AS l, list_sort(list(DISTINCT CAST(n_chars AS VARCHAR)))[1:10] AS c, list_sort(list(DISTINCT substr(text, 1, 150)))[1:3] AS q FROM documents GROUP BY source)
SELECT source, md5(substr(array_to_string(l || c || q, ' '), 1, 2000)) AS text_md5 FROM g""")
def paper_texts(spark, d):
    docs = load(spark, d, "documents").select("source", "lang", F.col("n_chars").cast("string").alias("c"), "text")
    return T.paper_text(docs, "source", {"lang": 30, "c": 10}, "text").select("source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("embedding_texts", """
SELECT doc_id, md5(concat_ws('. ', substr(source, 1, 500), CASE WHEN lang = 'en' THEN concat_ws(' ', lang, source) WHEN lang = 'de' THEN lang END, substr(text, 1, 300))) AS text_md5 FROM documents""")
def embedding_texts(spark, d):
    fields = {"en": [F.col("lang"), F.col("source")], "de": [F.col("lang")]}
    return load(spark, d, "documents").select("doc_id", F.md5(T.embedding_text(F.col("lang"), fields, F.col("text"), F.col("source")).cast("binary")).alias("text_md5"))


@register("label_similarity", """
WITH p AS (SELECT p_brand, p_name FROM (SELECT p_brand, p_name FROM part GROUP BY ALL)),
q AS (SELECT a.p_brand, a.p_name AS l, b.p_name AS r FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_name < b.p_name)
SELECT p_brand, l, r, round(1 - levenshtein(l, r) / greatest(length(l), length(r))::DOUBLE, 6) AS edit_ratio, round(len(list_intersect(string_split(l, ' '), string_split(r, ' ')))::DOUBLE / len(list_distinct(string_split(l, ' ') || string_split(r, ' '))), 6) AS jaccard FROM q""")
def label_similarity(spark, d):
    p = load(spark, d, "part").select("p_brand", "p_name").distinct()
    q = p.select("p_brand", F.col("p_name").alias("l")).join(p.select("p_brand", F.col("p_name").alias("r")), "p_brand").filter("l < r")
    return q.select("p_brand", "l", "r", F.round(T.edit_ratio(F.col("l"), F.col("r")), 6).alias("edit_ratio"), F.round(T.jaccard(F.split("l", " "), F.split("r", " ")), 6).alias("jaccard"))


@register("label_similarity_exact")
def label_similarity_exact(spark, d):
    """difflib's ratio needs Python; tests hold it against difflib itself."""
    p = load(spark, d, "part").select("p_brand", "p_name").distinct()
    q = p.select("p_brand", F.col("p_name").alias("l")).join(p.select("p_brand", F.col("p_name").alias("r")), "p_brand").filter("l < r")
    return q.select("p_brand", "l", "r", T.sequence_ratio(F.col("l"), F.col("r")).alias("ratio"))


@register("label_containment", """
WITH l AS (SELECT DISTINCT replace(p_name, ' ', '_') AS h FROM part), n AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS n FROM part)
SELECT n AS needle, count(*) AS n_labels FROM n JOIN l ON ('_' || h || '_') LIKE ('%\\_' || n || '\\_%') ESCAPE '\\' GROUP BY 1""")
def label_containment(spark, d):
    p = load(spark, d, "part")
    labels = p.select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("h")).distinct()
    words = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("needle")).distinct()
    # the boundary test as an equality on tokens, then the test itself
    keyed = labels.withColumn("needle", F.explode(F.array_distinct(F.split("h", "_"))))
    return keyed.join(words, "needle").filter(T.holds_label(F.col("needle"), F.col("h"))).groupBy("needle").agg(F.count("*").alias("n_labels"))


@register("term_expansion", """
WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS terms FROM part), e AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS term, split_part(p_name, ' ', 2) AS expansion FROM part),
x AS (SELECT p_partkey, terms, unnest(terms) AS term FROM t)
SELECT p_partkey AS query_id, array_to_string(list_sort(list(DISTINCT expansion))[1:10], ',') AS expansions FROM x JOIN e USING (term) WHERE NOT list_contains(terms, expansion) GROUP BY 1""")
def term_expansion(spark, d):
    p = load(spark, d, "part")
    q = p.select(F.col("p_partkey").alias("query_id"), F.split("p_name", " ").alias("terms"))
    words = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("expansion")).distinct()
    return T.expand_terms(q, words).select("query_id", F.array_join("expansions", ",").alias("expansions"))


@register("conversation_turn_pairs", """
SELECT conv_id, turn, role, lead(role) OVER w AS next_role, length(text) AS n_chars, lead(length(text)) OVER w AS next_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conversation_turn_pairs(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("long")
    return load(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), n.alias("n_chars"), F.lead(n).over(w).alias("next_chars"))
