"""Reads, filters, views, time, op-store, lifecycle and lineage queries."""

from pyspark.sql import functions as F

from quarry import schema
from quarry.functions.epochs import epoch, malformed
from quarry.operators import lifecycle, projections, providers, reads, textindex
from quarry.operators.filters import Filter, Json, source_type
from quarry.operators.projections import Projection
from quarry.operators.textindex import Okapi
from quarry.operators.views import ReadView
from quarry.plans.frames import ARTICLES, EDGES, NODES, NOW, VALID, articles, edges, nodes, searches
from quarry.plans.text_queries import _bm25
from quarry.session import table
from quarry.sources import corpus

ORDER_NOW = 900_000_000


def order_nodes(spark, d):
    """Orders as nodes with JSON bodies: every 7th has its priority as text, every 11th isn't JSON."""
    o = table(spark, d, "orders")
    level = F.substring("o_orderpriority", 1, 1)
    number = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), level.cast("int").alias("priority"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.struct(F.col("o_custkey").alias("key")).alias("customer")))
    text = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), level.alias("priority"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.struct(F.col("o_custkey").alias("key")).alias("customer")))
    body = F.when(F.col("o_orderkey") % 11 == 0, F.lit("no json")).when(F.col("o_orderkey") % 7 == 0, text).otherwise(number)
    return o.select(F.col("o_orderkey").alias("write_cursor"), F.concat(F.lit("order:"), "o_orderkey").alias("logical_id"), F.lit("todo").alias("kind"), body.alias("body"), F.concat(F.lit("cust:"), "o_custkey").alias("source_id"), F.lit("active").alias("state"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("valid_from"), (F.unix_seconds(F.col("o_orderdate").cast("timestamp")) + 86400 * (F.col("o_orderkey") % 90)).alias("valid_until"), F.lit(None).cast("long").alias("superseded_at"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("created_at"), F.col("o_orderstatus").alias("status"))


EVER = ReadView(include_out_of_window=True)


def read_get_many(spark, d):
    """Every endpoint of the edge table, in request order, with its node or none."""
    ids = edges(spark, d).select(F.col("from_id").alias("logical_id")).distinct().withColumn("pos", F.xxhash64("logical_id"))
    got = reads.get_many(nodes(spark, d), ids, NOW)
    return got.select("logical_id", "write_cursor", "body")


def read_get(spark, d):
    """The first hub by id, at one instant."""
    first = table(spark, d, "hub_node").agg(F.min("logical_id")).first()[0]
    return reads.get(nodes(spark, d), first or "", NOW).select("logical_id", "write_cursor", "kind", "body")


def instants_to_epoch(spark, d):
    """Times of articles written in several ways and read strictly: a date, with zone, without, and two that aren't instants."""
    at, way = F.col("created_at"), F.pmod(F.length("doc_id") + F.ascii("doc_id"), F.lit(5))
    written = [F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+01:00")), F.date_format(at, "yyyy-MM-dd HH:mm"), F.concat(F.date_format(at, "yyyy"), F.lit("-13-45"))]
    text = written[0]
    for i, w in enumerate(written[1:], 1):
        text = F.when(way == i, w).otherwise(text)
    rows = table(spark, d, "article").filter("doc_id IS NOT NULL AND created_at IS NOT NULL").select("doc_id", text.alias("written")).distinct()
    return rows.select("doc_id", epoch(F.col("written")).alias("at"), malformed(F.col("written")).alias("malformed"))


def excised_log(spark, d):
    """An event log and its latest rows after one user's purchases are excised."""
    log = table(spark, d, "events").select(F.col("event_type").alias("collection_name"), F.col("user_id").cast("string").alias("record_key"), F.col("event_id").alias("id"))
    one = log.filter("collection_name = 'purchase'").agg(F.min("record_key")).first()[0]
    kept, latest = lifecycle.excise_record(log, lifecycle.latest_state(log, ["collection_name", "record_key"], ["id"]), "purchase", one or "")
    left = kept.groupBy("collection_name").agg(F.count(F.lit(1)).alias("log_rows"))
    return left.join(latest.groupBy("collection_name").agg(F.count(F.lit(1)).alias("keys")), "collection_name")


def migrated_nodes(spark, d):
    """Nodes of the first layout read by the newest: what later layouts added is null."""
    first = nodes(spark, d).select("write_cursor", "logical_id", "kind", "body")
    return schema.migrate(first, "nodes", 1).select("write_cursor", "kind", "row_kind", "importance", "status")


def read_list_typed_predicates(spark, d):
    hits = Filter(json=(Json("$.status", "O"), Json("$.priority", 2, "lte"))).for_list(order_nodes(spark, d), "todo")
    return EVER.of(hits, NOW).select("logical_id")


def read_list_limited(spark, d):
    return reads.list_nodes(nodes(spark, d), "person", NOW, limit=100).select("write_cursor", "logical_id")


def filter_constant_fold(spark, d):
    """What a list of persons finds under filters on the kind: its own, none, and a contradiction, which is answered without reading."""
    out = None
    for name, where in (("own", Filter(kind="person")), ("none", Filter()), ("contradiction", Filter(kind="place"))):
        one = reads.list_nodes(nodes(spark, d), "person", NOW, where=where, limit=1000).agg(F.count(F.lit(1)).alias("nodes")).select(F.lit(name).alias("filter"), "nodes")
        out = one if out is None else out.unionByName(one)
    return out


def envelope_filter(spark, d):
    f = Filter(source_type="todo", status="F", created_after=ORDER_NOW)
    return f.for_search(order_nodes(spark, d)).select("logical_id")


def attribute_filter(spark, d):
    """Nodes whose projected priority is 1, as number or text alike."""
    n = order_nodes(spark, d)
    attrs = projections.attributes(n, {"priority": Projection("priority")})
    return Filter(attributes={"priority": 1}).for_search(n, attrs).select("logical_id")


def nested_attribute_projection(spark, d):
    declared = projections.configure({}, [Projection("customer", source=("customer", "key")), Projection("status", frozenset({"filterable", "searchable"}), full_text=True)])
    return projections.attributes(order_nodes(spark, d), declared.registry).groupBy("attr_name", "attr_value").agg(F.count(F.lit(1)).alias("nodes"))


def projected_text_search(spark, d):
    """Articles by the text of a searchable projection, their titles, ranked (F8)."""
    rows = articles(spark, d).select(F.col("doc_id").alias("write_cursor"), F.to_json(F.struct("title")).alias("body"))
    attrs = projections.attributes(rows, {"title": Projection("title", frozenset({"searchable"}), full_text=True)}).filter("attr_name = 'title'")
    hits = textindex.bm25(attrs, "write_cursor", F.col("attr_value"), searches(spark), Okapi(1.2, 0.75), every=False)
    return textindex.top(hits, 10).select("query_id", F.col("doc").alias("doc_id"), "score", "rank")


def source_types(spark, d):
    return table(spark, d, "documents").groupBy(source_type(F.col("source_type")).alias("source_type")).agg(F.count(F.lit(1)).alias("documents"))


def page_after_id(spark, d):
    return reads.page(table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type"), 500, 1000)


def valid_as_of(spark, d):
    return ReadView(valid_as_of=ORDER_NOW).of(order_nodes(spark, d), NOW).select("logical_id")


def read_view_matrix(spark, d):
    """Rows that each combination of relaxations sees."""
    n, out = nodes(spark, d), None
    for inactive in (False, True):
        for window in (False, True):
            view = ReadView(include_inactive=inactive, include_out_of_window=window)
            one = view.of(n, NOW).groupBy("kind").agg(F.count(F.lit(1)).alias("seen")).withColumns({"inactive": F.lit(inactive), "out_of_window": F.lit(window)})
            out = one if out is None else out.unionByName(one)
    return out


def boundary_crossings(spark, d):
    return reads.crossed_boundary(nodes(spark, d), NOW - 100_000_000, NOW).select("logical_id", "began", "ended")


def as_of_versions(spark, d):
    """The event version of each (user, type) that was valid at the start of every day it had events."""
    v = _versions(spark, d).select(F.col("logical_id"), F.col("at").alias("valid_from"), F.lead("at").over(_by_version()).alias("valid_until"), "write_cursor")
    asked = v.select("logical_id", (F.floor(F.col("valid_from") / 86400) * 86400).alias("day")).distinct()
    return reads.as_of_versions(v, asked, "logical_id", "day").select("logical_id", "day", "write_cursor")


def _by_version():
    from pyspark.sql.window import Window

    return Window.partitionBy("logical_id").orderBy("write_cursor")


def _versions(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("write_cursor"), F.concat_ws(":", "user_id", "event_type").alias("logical_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("at"), F.col("props").alias("body"))


def supersession_history(spark, d):
    return lifecycle.supersede(_versions(spark, d)).select("write_cursor", "logical_id", "superseded_at")


def latest_state(spark, d):
    log = table(spark, d, "events").select(F.col("event_type").alias("collection_name"), F.col("user_id").alias("record_key"), F.col("event_id").alias("id"), "value")
    return lifecycle.latest_state(log, ["collection_name", "record_key"], ["id"])


def append_log_page(spark, d):
    """The first thousand of one collection after a cursor."""
    log = table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id")
    return reads.page(log, 100, 1000)


def retention_cap(spark, d):
    """The newest 2,000 events; errors are kept for audit and don't count."""
    return lifecycle.retained(table(spark, d, "events"), 2000, "event_id", F.col("event_type") == "error").select("event_id")


def lifecycle_states(spark, d):
    """Three requests on every node, illegal ones refused."""
    n = nodes(spark, d)
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(s).alias("to_state")) for i, s in enumerate(("deleted", "active", "pending"))])
    asked = n.select("logical_id", F.explode(steps).alias("r")).select("logical_id", "r.*")
    return lifecycle.final_states(n, asked)


def erase_source_residue(spark, d):
    """What is left of the hubs' import after its erasure."""
    kept, _ = lifecycle.erase_source("seed-import", {"node": nodes(spark, d), "edge": edges(spark, d)}, {})
    return kept["node"].groupBy("kind").agg(F.count(F.lit(1)).alias("nodes"))


def erase_source_report(spark, d):
    _, counts = lifecycle.erase_source("seed-import", {"node": nodes(spark, d), "edge": edges(spark, d)}, {})
    return counts


def purge_cascade(spark, d):
    """What is left after every pending node is purged: nodes, edges and, as a shadow, the names of nodes."""
    n, e = nodes(spark, d), edges(spark, d)
    kept_nodes, kept_edges, shadows = lifecycle.purge_all(n, e, n.filter("state = 'pending'"), {"names": n.filter("body IS NOT NULL").select("write_cursor", "kind")})
    out = None
    for name, t in (("node", kept_nodes), ("edge", kept_edges), ("name", shadows["names"])):
        one = t.groupBy("kind").agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def trace_lineage(spark, d):
    return lifecycle.trace_source("seed-import", nodes(spark, d), edges(spark, d))


def row_counts(spark, d):
    return lifecycle.row_counts({"node": nodes(spark, d), "edge": edges(spark, d), "article": table(spark, d, "article")})


def provenance_census(spark, d):
    return lifecycle.provenance_census(edges(spark, d))


def high_water(spark, d):
    return lifecycle.high_water(nodes(spark, d), edges(spark, d))


def integrity_findings(spark, d):
    return lifecycle.integrity_findings(nodes(spark, d), edges(spark, d))


def write_validation(spark, d):
    """Rules that the edge rows break, were they written again."""
    return edges(spark, d).select(F.explode(lifecycle.edge_problems()).alias("problem")).groupBy("problem").agg(F.count(F.lit(1)).alias("row_count"))


def assigned_cursors(spark, d):
    """Articles numbered by arrival without sorting them in one task."""
    a = table(spark, d, "article").groupBy("doc_id").agg(F.max("ingested_at").alias("at"))
    return lifecycle.assign_cursors(a, ["at", "doc_id"], 1000).select("doc_id", "write_cursor")


def consolidate_recency(spark, d):
    facts = edges(spark, d)
    return providers.consolidate_by_recency(facts).select("write_cursor", "verdict", "new_t_invalid")


def merged_facts(spark, d):
    """The latest batch of facts (confidence known) replaces what it restates."""
    e = edges(spark, d)
    incoming = e.filter("superseded_at IS NULL AND confidence >= 0.9").groupBy("from_id", "to_id", "kind").agg(F.max("t_valid").alias("t_valid"))
    return providers.merge_facts(e, incoming, 99_000_000).groupBy(F.col("superseded_at").isNull().alias("is_current")).agg(F.count(F.lit(1)).alias("facts"))


def corpus_chains(spark, d):
    from quarry.operators.graph import chains

    return chains(table(spark, d, "article").select("doc_id", "parent_doc_id", "tags"))


def embedding_readiness(spark, d):
    """Articles by source type: which have a usable vector."""
    a = table(spark, d, "article").select(F.col("doc_id").alias("write_cursor"), F.col("source_type").alias("kind")).distinct()
    v = table(spark, d, "embshim_vector").filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("write_cursor"), (F.size("embedding") == 384).alias("ok"))
    return projections.readiness(a, v.filter("ok"), v.filter("NOT ok"))


def stable_digests(spark, d):
    lines = corpus.stable_lines(table(spark, d, "mix_target").withColumn("target_share", F.col("target_share").cast("string")), "source")
    return lines.select("source", "line", "digest")


def cache_misses(spark, d):
    """Articles without any vector."""
    return corpus.cache_misses(table(spark, d, "article").select("doc_id").distinct(), table(spark, d, "embshim_vector"), ["doc_id"])


QUERIES = {f.__name__: f for f in (read_get, instants_to_epoch, excised_log, migrated_nodes, read_get_many, read_list_typed_predicates, read_list_limited, filter_constant_fold, envelope_filter, attribute_filter, nested_attribute_projection, projected_text_search, source_types, page_after_id, valid_as_of, read_view_matrix, boundary_crossings, as_of_versions, supersession_history, latest_state, append_log_page, retention_cap, lifecycle_states, erase_source_residue, erase_source_report, purge_cascade, trace_lineage, row_counts, provenance_census, high_water, integrity_findings, write_validation, assigned_cursors, consolidate_recency, merged_facts, corpus_chains, embedding_readiness, stable_digests, cache_misses)}

_O = "o AS (SELECT *, 'order:' || o_orderkey AS logical_id, epoch(o_orderdate)::BIGINT AS born, cast(substr(o_orderpriority, 1, 1) AS INTEGER) AS level FROM orders)"
_V = "v AS (SELECT event_id AS write_cursor, user_id || ':' || event_type AS logical_id, epoch(date_trunc('second', ts))::BIGINT AS born FROM events)"
_COUNT = "count(*) AS"

SQL = {
    "read_get": f"WITH {NODES} SELECT logical_id, write_cursor, kind, body FROM node_rows WHERE logical_id = (SELECT min(logical_id) FROM hub_node) AND {VALID}",
    "instants_to_epoch": """WITH a AS (SELECT DISTINCT doc_id, created_at, (length(doc_id) + ascii(doc_id)) % 5 AS way FROM article WHERE doc_id IS NOT NULL AND created_at IS NOT NULL), s AS (SELECT doc_id, way, floor(epoch(created_at))::BIGINT AS s FROM a)
SELECT DISTINCT doc_id, CASE way WHEN 0 THEN s // 86400 * 86400 WHEN 1 THEN s WHEN 2 THEN s - 3600 END AS at, way >= 3 AS malformed FROM s""",
    "excised_log": """WITH l AS (SELECT event_type AS collection_name, cast(user_id AS VARCHAR) AS record_key FROM events), k AS (SELECT * FROM l WHERE NOT (collection_name = 'purchase' AND record_key = (SELECT min(record_key) FROM l WHERE collection_name = 'purchase')))
SELECT collection_name, count(*) AS log_rows, count(DISTINCT record_key) AS keys FROM k GROUP BY collection_name""",
    "migrated_nodes": f"WITH {NODES} SELECT write_cursor, kind, CAST(NULL AS VARCHAR) AS row_kind, CAST(NULL AS DOUBLE) AS importance, CAST(NULL AS VARCHAR) AS status FROM node_rows",
    "read_get_many": f"WITH {NODES}, {EDGES}, ids AS (SELECT DISTINCT from_id AS logical_id FROM edge_rows WHERE from_id IS NOT NULL), seen AS (SELECT * FROM node_rows WHERE {VALID}) SELECT logical_id, write_cursor, body FROM ids LEFT JOIN seen USING (logical_id)",
    "read_list_typed_predicates": f"WITH {_O} SELECT logical_id FROM o WHERE o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderstatus = 'O' AND level <= 2",
    "read_list_limited": f"WITH {NODES} SELECT write_cursor, logical_id FROM node_rows WHERE kind = 'person' AND {VALID} ORDER BY write_cursor LIMIT 100",
    "filter_constant_fold": f"WITH {NODES}, p AS (SELECT least(count(*), 1000) AS n FROM node_rows WHERE kind = 'person' AND {VALID}) SELECT 'own' AS filter, n AS nodes FROM p UNION ALL SELECT 'none', n FROM p UNION ALL SELECT 'contradiction', 0",
    "envelope_filter": f"WITH {_O} SELECT logical_id FROM o WHERE o_orderstatus = 'F' AND born >= {ORDER_NOW}",
    "attribute_filter": f"WITH {_O} SELECT logical_id FROM o WHERE o_orderkey % 11 <> 0 AND level = 1",
    "nested_attribute_projection": f"""WITH {_O}, ok AS (SELECT * FROM o WHERE o_orderkey % 11 <> 0)
SELECT 'customer' AS attr_name, cast(o_custkey AS VARCHAR) AS attr_value, {_COUNT} nodes FROM ok GROUP BY o_custkey UNION ALL SELECT 'status', o_orderstatus, count(*) FROM ok GROUP BY o_orderstatus""",
    "projected_text_search": f"WITH {ARTICLES}, " + _bm25("article_rows", "doc_id", "title", 1.2, 0.75, False, extra="WHERE title IS NOT NULL") + "SELECT query_id, doc AS doc_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10",
    "source_types": "SELECT CASE WHEN source_type IN ('email', 'article', 'paper', 'meeting', 'note', 'todo') THEN source_type WHEN source_type = 'doc' THEN 'article' END AS source_type, count(*) AS documents FROM documents GROUP BY 1",
    "page_after_id": "SELECT event_id AS id, event_type FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 1000",
    "valid_as_of": f"WITH {_O} SELECT logical_id FROM o WHERE born <= {ORDER_NOW} AND born + 86400 * (o_orderkey % 90) > {ORDER_NOW}",
    "read_view_matrix": f"""WITH {NODES}, flags AS (SELECT * FROM (VALUES (false), (true)) AS a(inactive), (VALUES (false), (true)) AS b(out_of_window))
SELECT kind, {_COUNT} seen, inactive, out_of_window FROM node_rows, flags
WHERE (inactive OR state = 'active') AND (out_of_window OR ((valid_from IS NULL OR valid_from <= {NOW}) AND (valid_until IS NULL OR valid_until > {NOW}))) GROUP BY kind, inactive, out_of_window""",
    "boundary_crossings": f"""WITH {NODES}, b AS (SELECT logical_id, coalesce(valid_from > {NOW - 100_000_000} AND valid_from <= {NOW}, false) AS began, coalesce(valid_until > {NOW - 100_000_000} AND valid_until <= {NOW}, false) AS ended FROM node_rows WHERE state = 'active')
SELECT logical_id, began, ended FROM b WHERE began OR ended""",
    "as_of_versions": f"""WITH {_V}, w AS (SELECT *, lead(born) OVER (PARTITION BY logical_id ORDER BY write_cursor) AS until FROM v), days AS (SELECT DISTINCT logical_id, born // 86400 * 86400 AS day FROM v)
SELECT logical_id, day, write_cursor FROM days JOIN w USING (logical_id) WHERE born <= day AND (until IS NULL OR until > day)""",
    "supersession_history": f"WITH {_V} SELECT write_cursor, logical_id, lead(write_cursor) OVER (PARTITION BY logical_id ORDER BY write_cursor) AS superseded_at FROM v",
    "latest_state": "SELECT event_type AS collection_name, user_id AS record_key, max(event_id) AS id, arg_max(value, event_id) AS value FROM events GROUP BY event_type, user_id",
    "append_log_page": "SELECT event_id AS id, user_id FROM events WHERE event_type = 'purchase' AND event_id > 100 ORDER BY event_id LIMIT 1000",
    "retention_cap": "WITH newest AS (SELECT event_id FROM events WHERE event_type <> 'error' ORDER BY event_id DESC LIMIT 2000) SELECT event_id FROM events WHERE event_type = 'error' OR event_id IN (SELECT event_id FROM newest)",
    "lifecycle_states": f"WITH {NODES} SELECT logical_id, 'active' AS state, 2 AS accepted, 1 AS refused FROM node_rows WHERE state IN ('active', 'pending')",
    "erase_source_residue": f"WITH {NODES} SELECT kind, {_COUNT} nodes FROM node_rows WHERE source_id IS NULL OR source_id <> 'seed-import' GROUP BY kind",
    "erase_source_report": f"WITH {NODES}, {EDGES} SELECT 'node' AS table_name, {_COUNT} erased FROM node_rows WHERE source_id = 'seed-import' UNION ALL SELECT 'edge', count(*) FROM edge_rows WHERE source_id = 'seed-import'",
    "purge_cascade": f"""WITH {NODES}, {EDGES}, gone AS (SELECT logical_id FROM node_rows WHERE state = 'pending'), kept AS (SELECT * FROM node_rows WHERE logical_id IS NULL OR logical_id NOT IN (SELECT logical_id FROM gone WHERE logical_id IS NOT NULL))
SELECT kind, {_COUNT} row_count, 'node' AS table_name FROM kept GROUP BY kind UNION ALL SELECT kind, count(*), 'name' FROM kept WHERE body IS NOT NULL GROUP BY kind
UNION ALL SELECT kind, count(*), 'edge' FROM edge_rows WHERE NOT coalesce(from_id IN (SELECT logical_id FROM gone), false) AND NOT coalesce(to_id IN (SELECT logical_id FROM gone), false) GROUP BY kind""",
    "trace_lineage": f"WITH {NODES}, {EDGES} SELECT 'node' AS row_kind, write_cursor FROM node_rows WHERE source_id = 'seed-import' UNION ALL SELECT 'edge', write_cursor FROM edge_rows WHERE source_id = 'seed-import'",
    "row_counts": f"WITH {NODES}, {EDGES} SELECT 'node' AS table_name, {_COUNT} row_count FROM node_rows UNION ALL SELECT 'edge', count(*) FROM edge_rows UNION ALL SELECT 'article', count(*) FROM article",
    "provenance_census": f"WITH {EDGES} SELECT source_id, {_COUNT} row_count, count(*) FILTER (superseded_at IS NULL) AS current_rows, count(logical_id) AS addressable_rows, coalesce(bool_or(source_id LIKE '\\_%' ESCAPE '\\'), false) AS reserved FROM edge_rows GROUP BY source_id",
    "high_water": f"WITH {NODES}, {EDGES} SELECT max(write_cursor) AS high_water FROM (SELECT write_cursor FROM node_rows UNION ALL SELECT write_cursor FROM edge_rows)",
    "integrity_findings": f"""WITH {NODES}, {EDGES}, f AS (
  SELECT 'cursor used twice' AS finding, count(*) AS row_count FROM (SELECT write_cursor FROM (SELECT write_cursor FROM node_rows UNION ALL SELECT write_cursor FROM edge_rows) GROUP BY write_cursor HAVING count(*) > 1)
  UNION ALL SELECT 'two current versions', count(*) FROM (SELECT logical_id FROM node_rows WHERE logical_id IS NOT NULL GROUP BY logical_id HAVING count(*) > 1)
  UNION ALL SELECT 'empty validity', count(*) FROM node_rows WHERE valid_until <= valid_from
  UNION ALL SELECT 'edge ends before it starts', count(*) FROM edge_rows WHERE t_invalid <= t_valid
  UNION ALL SELECT 'confidence out of range', count(*) FROM edge_rows WHERE confidence < 0 OR confidence > 1
  UNION ALL SELECT 'dangling endpoint', count(*) FROM (SELECT from_id AS id FROM edge_rows UNION ALL SELECT to_id FROM edge_rows) WHERE NOT coalesce(id IN (SELECT logical_id FROM node_rows WHERE state = 'active'), false)
) SELECT finding, row_count FROM f WHERE row_count > 0""",
    "write_validation": f"""WITH {EDGES}, p AS (
  SELECT 'source_id missing' AS problem FROM edge_rows WHERE source_id IS NULL OR trim(source_id) = '' UNION ALL SELECT 'endpoint missing' FROM edge_rows WHERE from_id IS NULL OR to_id IS NULL
  UNION ALL SELECT 'kind missing' FROM edge_rows WHERE kind IS NULL OR kind = '' UNION ALL SELECT 'confidence out of range' FROM edge_rows WHERE confidence < 0 OR confidence > 1 OR isnan(confidence)
) SELECT problem, {_COUNT} row_count FROM p GROUP BY problem""",
    "assigned_cursors": "WITH a AS (SELECT doc_id, max(ingested_at) AS arrived FROM article GROUP BY doc_id) SELECT doc_id, 1000 + row_number() OVER (ORDER BY arrived NULLS FIRST, doc_id) AS write_cursor FROM a",
    "consolidate_recency": f"""WITH {EDGES}, w AS (SELECT *, lead(t_valid) OVER k AS nt, lead(write_cursor) OVER k AS nc FROM edge_rows WHERE superseded_at IS NULL WINDOW k AS (PARTITION BY from_id, kind ORDER BY t_valid NULLS FIRST, write_cursor DESC))
SELECT write_cursor, CASE WHEN nc IS NULL THEN 'keep' ELSE 'invalidate' END AS verdict, CASE WHEN nc IS NULL THEN t_invalid ELSE coalesce(nt, t_valid) END AS new_t_invalid FROM w""",
    "merged_facts": f"""WITH {EDGES}, inc AS (SELECT DISTINCT from_id, to_id, kind FROM edge_rows WHERE superseded_at IS NULL AND confidence >= 0.9), old AS (SELECT superseded_at IS NULL AND inc.kind IS NULL AS is_current FROM edge_rows e LEFT JOIN inc ON e.from_id = inc.from_id AND e.to_id = inc.to_id AND e.kind = inc.kind)
SELECT is_current, count(*) AS facts FROM (SELECT is_current FROM old UNION ALL SELECT true FROM inc) GROUP BY is_current""",
    "corpus_chains": "SELECT DISTINCT parent_doc_id AS from_id, doc_id AS to_id, coalesce(list_filter(tags, lambda t: t LIKE 'relation:%')[1][10:], 'linked') AS kind FROM article WHERE parent_doc_id IN (SELECT doc_id FROM article)",
    "embedding_readiness": """WITH a AS (SELECT DISTINCT doc_id, source_type AS kind FROM article), ok AS (SELECT DISTINCT doc_id FROM embshim_vector WHERE len(embedding) = 384), bad AS (SELECT DISTINCT doc_id FROM embshim_vector WHERE len(embedding) <> 384),
c AS (SELECT kind, count(*) AS total, count(ok.doc_id) AS ready, count(*) FILTER (ok.doc_id IS NULL AND bad.doc_id IS NOT NULL) AS failed FROM a LEFT JOIN ok USING (doc_id) LEFT JOIN bad USING (doc_id) GROUP BY kind)
SELECT *, total - ready - failed AS pending, CASE WHEN total - ready - failed > 0 THEN 'pending' WHEN failed > 0 THEN 'failed' ELSE 'up_to_date' END AS state FROM c""",
    "stable_digests": """WITH l AS (SELECT source, '{"max_repeat":' || max_repeat || ',"source":"' || source || '","target_share":"' || target_share || '"}' AS line FROM mix_target) SELECT source, line, sha256(line) AS digest FROM l""",
    "cache_misses": "SELECT DISTINCT doc_id FROM article WHERE doc_id NOT IN (SELECT doc_id FROM embshim_vector WHERE doc_id IS NOT NULL)",
}
