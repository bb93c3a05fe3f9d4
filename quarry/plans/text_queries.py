"""Full-text queries."""

from pyspark.sql import functions as F

from quarry.functions.text import STOPWORDS, canon, terms
from quarry.operators import evalkit, textindex
from quarry.operators.textindex import Okapi
from quarry.operators.views import edge_live
from quarry.plans.frames import ARTICLES, EDGES, LIVE, NOW, SEARCHED, articles, as_integers, edges, searches
from quarry.session import cut, table


#: Searches in the control syntax of full-text engines.
HOSTILE = [("h1", 'harbour* AND "sensor" NEAR(team, 3)'), ("h2", "budget OR NOT (pension) -levy +council"), ("h3", "title:hatchery ^2 {invoice} [drop table]; --"), ("h4", '"" \' * : ( )')]


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def bm25_topk(spark, d):
    return textindex.top(textindex.bm25(_docs(spark, d), "doc_id", F.col("text"), searches(spark)), 10).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def bm25_corpus(spark, d):
    """The whole-corpus evaluation ranking with its own constants."""
    return textindex.top(textindex.bm25(articles(spark, d), "doc_id", F.col("body"), searches(spark), Okapi(1.2, 0.75)), 20).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def bm25_fielded(spark, d):
    fields = {"title": F.col("title"), "body": F.col("body")}
    scored = textindex.bm25_fielded(articles(spark, d), "doc_id", fields, searches(spark), Okapi(1.2, 0.75, {"title": 2.5, "body": 1.0}))
    return textindex.top(scored, 10).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def bm25_batch_queries(spark, d):
    """Every entity name of hub_node as a query."""
    names = table(spark, d, "hub_node").select(F.col("logical_id").alias("query_id"), F.col("body").alias("text")).distinct()
    return textindex.top(textindex.bm25(_docs(spark, d), "doc_id", F.col("text"), names), 10).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def bm25_title_queries(spark, d):
    """Every article's title as a query over all documents: thousands of searches in one pass."""
    titles = articles(spark, d).filter("title IS NOT NULL").select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    return textindex.bm25_top(_docs(spark, d), "doc_id", F.col("text"), titles, 5, every=False).select("query_id", F.col("doc").alias("doc_id"), "rank")


def text_prefix_limit(spark, d):
    """A smaller limit is a prefix of the larger one."""
    return bm25_topk(spark, d).filter("rank <= 3").select("query_id", "doc_id", "rank")


def content_or_match(spark, d):
    """How many of a query's content terms each document holds."""
    asked = textindex.query_terms(searches(spark))
    words = _docs(spark, d).select("doc_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    return words.join(F.broadcast(asked), "term").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("matched"))


def text_edge_facts(spark, d):
    facts = edges(spark, d).filter(edge_live(NOW) & F.col("body").isNotNull())
    return textindex.top(textindex.bm25(facts, "write_cursor", F.col("body"), searches(spark), every=False), 10).select("query_id", F.col("doc").alias("write_cursor"), "score", "rank")


def text_one_per_body(spark, d):
    """Edge facts with equal bodies count once, their scores added."""
    facts = edges(spark, d).filter(edge_live(NOW) & F.col("body").isNotNull())
    hits = textindex.bm25(facts, "write_cursor", F.col("body"), searches(spark), every=False)
    merged = textindex.one_per_body(hits.join(facts.select(F.col("write_cursor").alias("doc"), "body"), "doc"))
    return merged.select("query_id", "body", F.round("score", 9).alias("score"), "doc")


def bm25_porter(spark, d):
    """Search under Porter stems of folded terms (no SQL counterpart: stems)."""
    hits = textindex.bm25(_docs(spark, d), "doc_id", F.col("text"), searches(spark), stems=True)
    return textindex.top(hits, 10).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def tfidf_cosine(spark, d):
    """The ten documents with the largest TF-IDF cosine to each search."""
    hits = evalkit.tfidf_cosine(_docs(spark, d), "doc_id", terms(F.col("text")), searches(spark))
    return textindex.top(hits, 10).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def chunk_words(spark, d):
    docs = _docs(spark, d).filter("text IS NOT NULL")
    return evalkit.word_windows(docs, "doc_id", F.col("text"), 120, 100).select(F.col("doc").alias("doc_id"), "chunk", F.md5("chunk_text").alias("digest"), "n_words")


def paragraph_chunks(spark, d):
    return evalkit.paragraph_chunks(articles(spark, d), "doc_id", "body").select(F.col("doc").alias("doc_id"), "chunk", F.length("chunk_text").alias("n_chars"))


def tfidf_terms(spark, d):
    """The heaviest term of each document."""
    w = evalkit.tf_idf(_docs(spark, d), "doc_id", terms(F.col("text"))).withColumn("weight", F.round("weight", 9))
    return w.groupBy(F.col("doc").alias("doc_id")).agg(F.min_by(F.struct("term", "weight"), F.struct(-F.col("weight"), F.col("term"))).alias("t")).select("doc_id", "t.term", "t.weight")


def intent_classifier(spark, d):
    """Source type of a document by the nearest TF-IDF centroid, five folds, held out (no SQL counterpart)."""
    docs = table(spark, d, "documents").filter("text IS NOT NULL AND source_type IS NOT NULL").select("doc_id", "text", F.col("source_type").alias("label"))
    dealt = evalkit.folds(docs, "doc_id", "label", 5)
    predicted = evalkit.held_out(dealt.withColumnRenamed("doc_id", "doc"), terms(F.col("text")), 5)
    return predicted.groupBy("label", "predicted").agg(F.count(F.lit(1)).alias("documents"))


def literal_syntax_search(spark, d):
    """Searches full of another engine's control syntax: every run of letters is a term and nothing else is."""
    hits = textindex.bm25(_docs(spark, d), "doc_id", F.col("text"), spark.createDataFrame(HOSTILE, "query_id string, text string"), every=False)
    return textindex.top(hits, 10).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def hit_sources(spark, d):
    """Facts found by text with the source each came from."""
    facts = edges(spark, d).filter(edge_live(NOW) & F.col("body").isNotNull())
    hits = textindex.top(textindex.bm25(facts, "write_cursor", F.col("body"), searches(spark), every=False), 20)
    return hits.join(facts.select(F.col("write_cursor").alias("doc"), "source_id"), "doc").select("query_id", F.col("doc").alias("write_cursor"), "source_id", "rank")


def coverage_themes(spark, d):
    """Themes of the articles, clusters of windows each summed up by its first words, for every search (no SQL counterpart: seeded iteration)."""
    from quarry.engine import hashing_embedder

    embed = hashing_embedder(64)

    @F.pandas_udf("array<float>")
    def vectors(texts):
        import pandas as pd

        return pd.Series(embed(texts.tolist()))

    windows = evalkit.word_windows(articles(spark, d).filter("body IS NOT NULL"), "doc_id", F.col("body"), 200, 200)
    chunks = cut(windows.select(F.concat_ws("#", "doc", "chunk").alias("chunk"), "chunk_text", vectors("chunk_text").alias("vector")))
    index = cut(evalkit.coverage_index(chunks, 12, lambda texts: " ".join(" ".join(t.split()[:8]) for t in texts[:4]), embed))
    asked = searches(spark).select("query_id", vectors("text").alias("q"))
    return evalkit.themes(index, asked, 3).select("query_id", "cluster", "rank")


def canonical_names(spark, d):
    """Node names by canonical form."""
    return table(spark, d, "node").select(canon(F.col("body")).alias("name"), "logical_id").groupBy("name").agg(F.count_distinct("logical_id").alias("nodes"))


def enriched_text(spark, d):
    """Articles with the surfaces of their entities appended."""
    docs = articles(spark, d)
    names = table(spark, d, "article").select("doc_id", F.explode("entity_ids").alias("e")).select("doc_id", F.col("e.surface").alias("name")).filter("name IS NOT NULL").distinct()
    return evalkit.enriched(docs, "doc_id", "body", names).select("doc_id", F.md5("body").alias("digest"))


def _bm25(source, key, text, k1, b, every=True, queries=SEARCHED, extra="", asked_from="searched"):
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    distinct = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
    content = f"list_filter({distinct}, lambda t: length(t) >= 3 AND t NOT IN ({stop}))"
    chosen = distinct if every else f"CASE WHEN len({content}) > 0 THEN {content} ELSE {distinct} END"
    return f"""
{queries}, asked AS (SELECT query_id, unnest({chosen}) AS term FROM {asked_from}),
tok AS (SELECT {key} AS doc, regexp_extract_all(lower(coalesce({text}, '')), '[a-z0-9]+') AS ts FROM {source} {extra}),
stats AS (SELECT count(*) AS n, avg(len(ts)) AS m FROM tok),
hit AS (SELECT doc, term, any_value(l) AS l, count(*) AS tf FROM (SELECT doc, len(ts) AS l, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY doc, term),
dfs AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
scored AS (
  SELECT query_id, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * l / m))), 9) AS score
  FROM hit JOIN dfs USING (term) JOIN asked USING (term), stats GROUP BY query_id, doc
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM scored)
"""


_TOPK = "WITH " + _bm25("documents", "doc_id", "text", 1.5, 0.75)
_FACTS = f"WITH {EDGES}, " + _bm25("edge_rows", "write_cursor", "body", 1.5, 0.75, False, extra=f"WHERE {LIVE} AND body IS NOT NULL")
_BLANK = r"[ \t\n\x0b\f\r]+"

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_corpus, bm25_fielded, bm25_batch_queries, bm25_title_queries, text_prefix_limit, content_or_match, text_edge_facts, text_one_per_body, bm25_porter, chunk_words, paragraph_chunks, tfidf_terms, tfidf_cosine, literal_syntax_search, hit_sources, coverage_themes, intent_classifier, canonical_names, enriched_text)}

SQL = {
    "bm25_topk": _TOPK + "SELECT query_id, doc AS doc_id, score, rank FROM ranked WHERE rank <= 10",
    "text_prefix_limit": _TOPK + "SELECT query_id, doc AS doc_id, rank FROM ranked WHERE rank <= 3",
    "bm25_corpus": f"WITH {ARTICLES}, " + _bm25("article_rows", "doc_id", "body", 1.2, 0.75) + "SELECT query_id, doc AS doc_id, score, rank FROM ranked WHERE rank <= 20",
    "bm25_batch_queries": "WITH " + _bm25("documents", "doc_id", "text", 1.5, 0.75, queries="named AS (SELECT DISTINCT logical_id AS query_id, body AS text FROM hub_node)", asked_from="named") + "SELECT query_id, doc AS doc_id, score, rank FROM ranked WHERE rank <= 10",
    "bm25_title_queries": f"WITH {ARTICLES}, " + _bm25("documents", "doc_id", "text", 1.5, 0.75, False, queries="titled AS (SELECT doc_id AS query_id, title AS text FROM article_rows WHERE title IS NOT NULL)", asked_from="titled") + "SELECT query_id, doc AS doc_id, rank FROM ranked WHERE rank <= 5",
    "bm25_fielded": f"""
WITH {ARTICLES}, {SEARCHED}, asked AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM searched),
tok AS (
  SELECT doc_id AS doc, 'title' AS field, 2.5 AS w, regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+') AS ts FROM article_rows
  UNION ALL SELECT doc_id, 'body', 1.0, regexp_extract_all(lower(coalesce(body, '')), '[a-z0-9]+') FROM article_rows
), stats AS (SELECT field, count(*) AS n, avg(len(ts)) AS m FROM tok GROUP BY field),
hit AS (SELECT doc, field, w, l, term, count(*) AS tf FROM (SELECT doc, field, w, len(ts) AS l, unnest(ts) AS term FROM tok) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
part AS (SELECT doc, term, sum(w * tf / (0.25 + 0.75 * l / m)) AS x, any_value(n) AS n FROM hit JOIN stats USING (field) GROUP BY doc, term),
dfs AS (SELECT term, count(DISTINCT doc) AS df FROM hit GROUP BY term),
scored AS (SELECT query_id, doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * x / (1.2 + x)), 9) AS score FROM part JOIN dfs USING (term) JOIN asked USING (term) GROUP BY query_id, doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM scored)
SELECT query_id, doc AS doc_id, score, rank FROM ranked WHERE rank <= 10
""",
    "content_or_match": "WITH " + _bm25("documents", "doc_id", "text", 1.5, 0.75, False) + "SELECT query_id, doc AS doc_id, count(*) AS matched FROM hit JOIN asked USING (term) GROUP BY query_id, doc",
    "text_edge_facts": _FACTS + "SELECT query_id, doc AS write_cursor, score, rank FROM ranked WHERE rank <= 10",
    "text_one_per_body": _FACTS + "SELECT query_id, body, round(sum(score), 9) AS score, min(doc) AS doc FROM scored JOIN edge_rows ON doc = write_cursor GROUP BY query_id, body",
    "chunk_words": f"""
WITH words AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_BLANK}'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, text, w, unnest(CASE WHEN len(w) > 120 THEN range(0, cast(ceil((len(w) - 120) / 100) AS BIGINT) + 1) ELSE [0] END) AS i FROM words)
SELECT doc_id, cast(i AS INTEGER) AS chunk, md5(CASE WHEN len(w) > 120 THEN array_to_string(w[i * 100 + 1 : i * 100 + 120], ' ') ELSE text END) AS digest,
  cast(CASE WHEN len(w) > 120 THEN len(w[i * 100 + 1 : i * 100 + 120]) ELSE len(w) END AS INTEGER) AS n_words FROM starts
""",
    "paragraph_chunks": f"""
WITH RECURSIVE {ARTICLES}, big AS (SELECT doc_id, title, body, string_split(body, chr(10) || chr(10)) AS ps FROM article_rows WHERE length(body) > 6000),
walk(doc_id, title, body, i, size, g) AS (
  SELECT doc_id, title, body, 1, length(ps[1]), 0 FROM big UNION ALL
  SELECT b.doc_id, b.title, b.body, i + 1, CASE WHEN size = 0 OR size + 2 + length(ps[i + 1]) > 6000 THEN length(ps[i + 1]) ELSE size + 2 + length(ps[i + 1]) END, g + CASE WHEN size > 0 AND size + 2 + length(ps[i + 1]) > 6000 THEN 1 ELSE 0 END
  FROM walk AS w JOIN big AS b ON b.doc_id = w.doc_id AND b.body = w.body AND b.title IS NOT DISTINCT FROM w.title WHERE i < len(ps)
), packed AS (SELECT doc_id, title, body, g, arg_max(size, i) AS size FROM walk GROUP BY ALL),
cut AS (SELECT doc_id, title, body, g, size, unnest(range(0, CAST(ceil(size / 6000) AS BIGINT))) AS k FROM packed WHERE size > 0)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id, title, body ORDER BY g, k) - 1 AS INTEGER) AS chunk, CAST(least(6000, size - k * 6000) AS INTEGER) AS n_chars FROM cut
UNION ALL SELECT doc_id, 0, CAST(length(body) AS INTEGER) FROM article_rows WHERE length(body) <= 6000
""",
    "tfidf_terms": """
WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY doc_id, term), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM documents),
raw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN dfs USING (term), n),
unit AS (SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 9) AS weight FROM raw)
SELECT doc_id, term, weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) AS r FROM unit) WHERE r = 1
""",
    "literal_syntax_search": "WITH " + _bm25("documents", "doc_id", "text", 1.5, 0.75, False, queries="hostile(query_id, text) AS (VALUES " + ", ".join("('{}', '{}')".format(q, t.replace("'", "''")) for q, t in HOSTILE) + ")", asked_from="hostile") + "SELECT query_id, doc AS doc_id, score, rank FROM ranked WHERE rank <= 10",
    "hit_sources": _FACTS + "SELECT query_id, doc AS write_cursor, source_id, rank FROM ranked JOIN edge_rows ON doc = write_cursor WHERE rank <= 20",
    "canonical_names": r"SELECT array_to_string(list_filter(string_split_regex(lower(strip_accents(coalesce(body, ''))), '[\s\x{a0}\x{3000}]+'), lambda x: x <> ''), ' ') AS name, count(DISTINCT logical_id) AS nodes FROM node GROUP BY 1",
    "tfidf_cosine": f"""
WITH {SEARCHED}, tok AS (SELECT doc_id AS doc, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents),
tf AS (SELECT doc, term, count(*) AS tf FROM tok GROUP BY doc, term), dfs AS (SELECT term, ln(n / count(*)) + 1 AS idf FROM tf, n GROUP BY term, n),
norms AS (SELECT doc, sqrt(sum(tf * idf * tf * idf)) AS z FROM tf JOIN dfs USING (term) GROUP BY doc),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM searched) GROUP BY query_id, term),
qw AS (SELECT query_id, term, qf * idf AS w, idf FROM q JOIN dfs USING (term)), qn AS (SELECT query_id, sqrt(sum(w * w)) AS z FROM qw GROUP BY query_id),
scored AS (SELECT query_id, doc, round(sum(w * tf * idf) / (any_value(norms.z) * any_value(qn.z)), 9) AS score FROM tf JOIN qw USING (term) JOIN norms USING (doc) JOIN qn USING (query_id) GROUP BY query_id, doc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM scored)
SELECT query_id, doc AS doc_id, score, rank FROM ranked WHERE rank <= 10
""",
    "enriched_text": f"""
WITH {ARTICLES}, names AS (SELECT DISTINCT doc_id, e.surface AS name FROM (SELECT doc_id, unnest(entity_ids) AS e FROM article) WHERE e.surface IS NOT NULL),
joined AS (SELECT doc_id, array_to_string(list_sort(list(name)), ' ') AS names FROM names GROUP BY doc_id)
SELECT doc_id, md5(CASE WHEN body IS NULL THEN coalesce(names, '') WHEN names IS NULL THEN body ELSE body || chr(10) || names END) AS digest FROM article_rows LEFT JOIN joined USING (doc_id)
""",
}

SQL = as_integers(SQL, {"bm25_topk": ["rank"], "text_prefix_limit": ["rank"], "bm25_corpus": ["rank"], "bm25_batch_queries": ["rank"], "bm25_fielded": ["rank"], "text_edge_facts": ["rank"], "tfidf_cosine": ["rank"], "literal_syntax_search": ["rank"], "hit_sources": ["rank"], "bm25_title_queries": ["rank"]})
