"""The verbs over a table location: a thin layer that loads, calls operators and commits (S1, S4, H1, appendix A).

A workspace is a folder in any store that Spark reads.  Tables are lists of Parquet folders; a commit adds folders with what
is new and then one file that lists all folders in force, so a batch is seen whole or not at all.  Rows are
appended, never rewritten: that a version has been superseded is a row of its own, joined when the table is read.  Erasure and
lifecycle verbs rewrite what they touch.  There is one committer, the driver.
"""

from __future__ import annotations

import json
import time
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry import schema
from quarry.errors import IllegalTransition, InvalidArgument, UnknownCollection, WriteRejected
from quarry.functions.text import terms
from quarry.operators import fusion, graph, lifecycle, projections, providers, reads, textindex, vector
from quarry.operators.filters import Filter, Json
from quarry.operators.projections import Projection
from quarry.operators.textindex import Okapi
from quarry.operators.views import DEFAULT_VIEW, ReadView, edge_live
from quarry.session import cut
from quarry.sources import corpus
from quarry.storage import Store

Embedder = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class Options:
    """How a search runs: its view, the arms and weights beyond text and vectors, and the reranking."""

    view: ReadView = DEFAULT_VIEW
    use_graph_arm: bool = False
    recency: bool = False
    importance: bool = False
    rerank_depth: int = 0
    alpha: float = 0.3
    scorer: Callable[[str, list[str]], list[float]] | None = None


@dataclass(frozen=True)
class Explanation:
    """``hits``, a row per hit of what placed it in ``per_hit``, and the ``trace`` of the query, which holds no text."""

    hits: DataFrame
    per_hit: DataFrame
    trace: dict


class Engine:
    """A workspace at ``path``.  ``now`` gives the instant of reads without one; nothing in a plan reads the clock."""

    def __init__(self, spark: SparkSession, path: str, now: Callable[[], int] = lambda: int(time.time()), embedder: Embedder | None = None, dim: int = 384):
        self.spark, self.path, self.now, self.embedder, self.dim = spark, str(path), now, embedder, dim
        self.store = Store(spark, self.path)
        self.counters: Counter = Counter()
        self.errors_by_code: Counter = Counter()
        self.telemetry: Store | None = None
        self.last_query_id: str | None = None
        self.slow_threshold_ms: int | None = None
        self.profile: list[tuple[str, float]] = []
        self.dense_disabled_reason: str | None = None
        commits = [n for n in self.store.names("commits") if n.endswith(".json")]
        fresh = {"version": schema.VERSION, "commit": 0, "cursor": 0, "collections": {}, "config": {}, "registry": {}, "tables": {}, "mean": None}
        self.meta = json.loads(self.store.read(f"commits/{commits[-1]}")) if commits else fresh
        if self.meta["version"] > schema.VERSION:
            raise InvalidArgument(f"version {self.meta['version']} is newer than {schema.VERSION}")

    # -- storage

    def _stored(self, name: str) -> DataFrame:
        parts = self.meta["tables"].get(name, [])
        if not parts:
            return schema.empty(self.spark, name)
        return schema.migrate(self.spark.read.schema(schema.TABLES[name]).parquet(*map(self.store.at, parts)), name, self.meta["version"])

    def table(self, name: str) -> DataFrame:
        """A table in force; versions of nodes and edges with the cursor that superseded them."""
        rows = self._stored(name)
        if name not in schema.ENDS or not self.meta["tables"].get(schema.ENDS[name]):
            return rows
        ends = self._stored(schema.ENDS[name]).groupBy("write_cursor").agg(F.min("superseded_at").alias("__end"))
        joined = rows.join(ends, "write_cursor", "left").withColumn("superseded_at", F.coalesce("__end", "superseded_at")).drop("__end")
        return joined.select(*rows.columns)

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"data/{self.meta['commit'] + 1:08}-{uuid.uuid4().hex[:12]}-{name}"
        schema.fitted(rows, name).write.parquet(self.store.at(part))
        return part

    def _commit(self, replaced: dict[str, DataFrame] | None = None, appended: dict[str, DataFrame] | None = None, parts: dict[str, list[str]] | None = None, **meta) -> int:
        """Put tables, rows, or parts that are written already in force together."""
        tables = dict(self.meta["tables"])
        for name, rows in (replaced or {}).items():
            tables[name] = [self._write(name, rows)]
            if name in schema.ENDS:  # the rows carry their ends now
                tables[schema.ENDS[name]] = []
        for name, rows in (appended or {}).items():
            tables[name] = [*tables.get(name, []), self._write(name, rows)]
        for name, more in (parts or {}).items():
            tables[name] = [*tables.get(name, []), *more]
        after = {**self.meta, **meta, "tables": tables, "version": schema.VERSION, "commit": self.meta["commit"] + 1}
        self.store.write_new(f"commits/{after['commit']:012}.json", json.dumps(after, sort_keys=True))
        self.meta = after
        self.counters["commits"] += 1
        return self.meta["cursor"]

    def vacuum(self) -> int:
        """Remove the folders and commits that aren't in force, so that what was erased is gone from disk; the number of folders removed."""
        used = {p for parts in self.meta["tables"].values() for p in parts}
        gone = [n for n in self.store.names("data") if f"data/{n}" not in used]
        for n in self.store.names("commits"):
            if n != f"{self.meta['commit']:012}.json":
                self.store.delete(f"commits/{n}")
        return sum(self.store.delete(f"data/{n}") for n in gone)

    def compact(self) -> None:
        """One folder per table, ends in their rows; shadows of versions that aren't current are dropped."""
        nodes = self.table("nodes")
        current = nodes.filter("superseded_at IS NULL").select("write_cursor")
        shadows = {t: self.table(t).join(current, "write_cursor", "left_semi") for t in ("attributes", "vectors")}
        self._commit({"nodes": nodes, "edges": self.table("edges"), "log": self.table("log"), "state": self._latest(self.table("state")), **shadows})
        self.vacuum()

    def open_report(self) -> dict:
        return {"version": self.meta["version"], "commit": self.meta["commit"], "cursor": self.meta["cursor"], "dense_disabled": self.dense_disabled}

    def close(self) -> None:
        self.counters["closed"] += 1

    # -- writes

    def write(self, nodes: list[dict] | DataFrame | None = None, edges: list[dict] | DataFrame | None = None) -> dict:
        """Validate all, give every row a cursor in order, supersede earlier versions, commit; ``{cursor, dangling}``.

        Only what is new is written: the rows, the ends of the versions they replace, their attributes.
        """
        self._count("write")
        batches, cursor = {}, self.meta["cursor"]
        for name, rows, problems in (("nodes", nodes, lifecycle.node_problems), ("edges", edges, lifecycle.edge_problems)):
            if rows is None:
                continue
            fresh = self._batch(rows, name)
            if name == "nodes":
                fresh = fresh.fillna({"state": "active", "row_kind": "leaf", "status": ""})
                projections.require_scalars(fresh, self._registry())
            batches[name] = lifecycle.accept(fresh, problems())
        parts: dict[str, list[str]] = {}
        added = {}
        for name, fresh in batches.items():
            numbered = lifecycle.assign_cursors(fresh.drop("write_cursor", "superseded_at"), ["__order"], cursor).drop("__order")
            part = self._write(name, numbered)
            added[name] = self.spark.read.schema(schema.TABLES[name]).parquet(self.store.at(part))
            cursor = added[name].agg(F.coalesce(F.max("write_cursor"), F.lit(cursor))).first()[0]
            key = ["write_cursor", "logical_id"]
            mine = added[name].filter("logical_id IS NOT NULL").select(*key)
            before = self.table(name).filter("superseded_at IS NULL").select(*key).join(mine.select("logical_id").distinct(), "logical_id", "left_semi")
            ended = lifecycle.supersede(before.unionByName(mine)).filter("superseded_at IS NOT NULL").select("write_cursor", "superseded_at")
            parts[name], parts[schema.ENDS[name]] = [part], [self._write(schema.ENDS[name], ended)]
        if "nodes" in added and self._registry():
            parts["attributes"] = [self._write("attributes", projections.attributes(added["nodes"].filter("state = 'active'"), self._registry()))]
        known = self.table("nodes")
        if "nodes" in added:
            # An id that the batch writes again is known by its newest version only.
            known = known.join(added["nodes"].select("logical_id").distinct(), "logical_id", "left_anti").unionByName(added["nodes"])
        dangling = lifecycle.dangling_endpoints(added["edges"], known).count() if "edges" in added else 0
        return {"cursor": self._commit(parts=parts, cursor=cursor), "dangling": dangling}

    def _batch(self, rows: list[dict] | DataFrame, name: str) -> DataFrame:
        if isinstance(rows, DataFrame):
            return schema.fitted(rows, name).withColumn("__order", F.monotonically_increasing_id())
        names = [c.split(" ", 1)[0] for c in schema.TABLES[name].split(", ")]
        for r in rows:
            if unknown := r.keys() - set(names) - {"from", "to"}:
                raise WriteRejected(f"no such keys: {sorted(unknown)}")
            if any(isinstance(r.get(k), bool) for k in ("valid_from", "valid_until", "t_valid", "t_invalid", "confidence")):
                raise WriteRejected("a boolean is no number")
        flat = [{**{"from_id": r["from"], "to_id": r["to"]}, **{k: v for k, v in r.items() if k not in ("from", "to")}} if "from" in r else r for r in rows]
        return self.spark.createDataFrame([tuple(r.get(n) for n in names) + (i,) for i, r in enumerate(flat)], f"{schema.TABLES[name]}, __order long")

    def transition(self, logical_id: str, to_state: str, reason: str | None = None) -> None:
        self._commit({"nodes": lifecycle.transition(self.table("nodes"), logical_id, to_state, reason)})

    def purge(self, logical_id: str) -> None:
        n, e, shadows = lifecycle.purge(self.table("nodes"), self.table("edges"), logical_id, {t: self.table(t) for t in ("attributes", "vectors")})
        self._commit({"nodes": n, "edges": e, **shadows})
        self.vacuum()

    def erase_source(self, source_id: str) -> dict[str, int]:
        """Rows erased per table; their files are removed too.  Repeating it erases nothing."""
        kept, counts = lifecycle.erase_source(source_id, {"nodes": self.table("nodes"), "edges": self.table("edges")}, {t: self.table(t) for t in ("attributes", "vectors")})
        report = {r.table_name: r.erased for r in counts.collect()}
        self._commit(kept)
        self.vacuum()
        return report

    # -- op-store

    def configure(self, name: str, kind: str, json_schema: dict | None = None) -> None:
        """Register a collection: append_only_log or latest_state."""
        if kind not in ("append_only_log", "latest_state"):
            raise InvalidArgument(f"no such kind of collection: {kind!r}")
        self._commit(collections={**self.meta["collections"], name: {"kind": kind, "schema": schema.check_schema(json_schema or {})}})

    def put(self, collection: str, rows: list[tuple[str, str]]) -> int:
        """Append (record_key, payload) rows; a latest-state collection keeps the last of each key."""
        if collection not in self.meta["collections"]:
            raise UnknownCollection(collection)
        known = self.meta["collections"][collection]
        if bad := [p for _, body in rows for p in schema.payload_problems(body, known["schema"])]:
            raise WriteRejected("; ".join(bad[:5]))
        c = self.meta["cursor"]
        fresh = self.spark.createDataFrame([(c + i, collection, k, "append", b, None, c + i) for i, (k, b) in enumerate(rows, 1)], schema.LOG)
        added = {"log": fresh}
        if known["kind"] == "latest_state":
            added["state"] = fresh.select("collection_name", "record_key", "payload_json", "schema_id", "write_cursor")
        return self._commit(appended=added, cursor=c + len(rows))

    def collection(self, name: str, after_id: int = 0, limit: int = 100) -> DataFrame:
        if name not in self.meta["collections"]:
            raise UnknownCollection(name)
        return reads.page(self.table("log").filter(F.col("collection_name") == name), after_id, limit)

    def state(self, name: str) -> DataFrame:
        return self._latest(self.table("state").filter(F.col("collection_name") == name))

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        return lifecycle.latest_state(rows, ["collection_name", "record_key"], ["write_cursor"])

    def mutations(self, after_id: int = 0, limit: int = 100) -> DataFrame:
        return reads.page(self.table("log"), after_id, limit)

    def excise_record(self, collection: str, record_key: str) -> None:
        log, state = lifecycle.excise_record(self.table("log"), self.table("state"), collection, record_key)
        self._commit({"log": log, "state": state})
        self.vacuum()

    # -- reads

    def get(self, logical_id: str, view: ReadView = DEFAULT_VIEW) -> DataFrame:
        return reads.get(self.table("nodes"), logical_id, self.now(), view)

    def get_many(self, ids: list[str], view: ReadView = DEFAULT_VIEW) -> DataFrame:
        asked = self.spark.createDataFrame(list(enumerate(ids)), "pos int, logical_id string")
        return reads.get_many(self.table("nodes"), asked, self.now(), view).orderBy("pos")

    def list(self, kind: str, predicates: tuple[Json, ...] = (), where: Filter = Filter(), limit: int = 100, view: ReadView = DEFAULT_VIEW) -> DataFrame:
        return reads.list_nodes(self.table("nodes"), kind, self.now(), where=where, predicates=predicates, limit=limit, view=view, attributes=self.table("attributes"))

    def rows_of(self, row_kind: str, view: ReadView = DEFAULT_VIEW) -> DataFrame:
        """Nodes of one structural kind: leaf, coverage or graph."""
        if row_kind not in schema.ROW_KINDS:
            raise InvalidArgument(f"no such kind of row: {row_kind!r}")
        return view.of(self.table("nodes"), self.now()).filter(F.coalesce("row_kind", F.lit("leaf")) == row_kind)

    def crossed_boundary_since(self, since: int, view: ReadView = DEFAULT_VIEW) -> DataFrame:
        return reads.crossed_boundary(self.table("nodes"), since, self.now(), view)

    # -- search

    def search(self, query: str, where: Filter = Filter(), limit: int = 10, **options) -> DataFrame:
        """Hybrid search: text and vector arms, optionally the graph arm, fused by body, reweighted, reranked, cut.

        ``options`` are those of ``Options``.  The rows keep the rank of each arm.
        """
        out = self._searched(query, where, limit, Options(**options))[0]
        self._tell(query, out)
        return out.orderBy("rank")

    def search_explained(self, query: str, where: Filter = Filter(), limit: int = 10, **options) -> Explanation:
        """The hits of ``search`` with, hit by hit, what placed them, and a trace of the query."""
        o = Options(**options)
        out, arms, dropped = self._searched(query, where, limit, o)
        self._tell(query, out)
        hits = {n: a.count() for n, a in arms.items()}
        trace = {
            "query_chars": len(query), "k": limit, "rerank_depth": o.rerank_depth, "pool_n": o.rerank_depth, "alpha": o.alpha, "use_graph_arm": o.use_graph_arm, "recency": o.recency,
            "embedder_id": "" if self.embedder is None else f"{getattr(self.embedder, '__name__', 'embedder')} (dim={self.dim})", "ce_active": bool(o.rerank_depth and o.scorer is not None),
            **{f"{n}_hits": hits.get(n, 0) for n in fusion.ARM_ORDER}, "dropped_edge_hits": dropped.count(), "missing": [n for n in arms if not hits[n]],
        }
        none = F.lit(None)
        wanted = {"id": F.col("write_cursor"), "arm": F.col("branch")} | {f"{n}_rank": F.col(f"{n}_rank") if n in arms else none.cast("int") for n in fusion.ARM_ORDER}
        ce = F.col("ce_score") if "ce_score" in out.columns else none.cast("double")
        blended = F.coalesce("blended", "score") if "blended" in out.columns else F.col("score")
        per_hit = out.orderBy("rank").select(*[c.alias(n) for n, c in wanted.items()], F.col("score").alias("fused_score"), ce.alias("ce_score"), blended.alias("blended"), "importance", "confidence")
        return Explanation(out.orderBy("rank"), per_hit, trace)

    def _searched(self, query: str, where: Filter, limit: int, o: Options) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
        textindex.check_limit(limit)
        o.view.for_search()
        now, asked = self.now(), self.spark.createDataFrame([("q", query)], "query_id string, text string")
        seen = where.for_search(o.view.of(self.table("nodes"), now), self.table("attributes"))
        # Attributes belong to nodes, so a filter on one leaves edges out.
        live = self.table("edges").filter(edge_live(now) & F.col("body").isNotNull()).withColumns({"created_at": F.lit(None).cast("long"), "status": F.lit("")})
        other = replace(where, attributes={}) if where.attributes else where
        all_facts = other.for_search(live)
        facts = all_facts.limit(0) if where.attributes else all_facts
        rows = seen.select("write_cursor", "logical_id", "kind", "body", "source_id", "importance", F.lit(None).cast("double").alias("confidence"))
        as_rows = lambda e: e.select("write_cursor", "logical_id", "kind", "body", "source_id", F.lit(None).cast("double").alias("importance"), "confidence")
        both = rows.unionByName(as_rows(facts))
        hits = cut(textindex.top(textindex.bm25(both, "write_cursor", F.col("body"), asked, Okapi(1.2, 0.75), every=False, stems=True), textindex.MOST_RESULTS))
        dropped = textindex.bm25(all_facts, "write_cursor", F.col("body"), asked, every=False, stems=True) if where.attributes else hits.limit(0)
        arms = {"text": hits.join(both.withColumnRenamed("write_cursor", "doc"), "doc").withColumnRenamed("doc", "write_cursor").drop("score")}
        if self.embedder is not None and not self.dense_disabled:
            # Only vectors of rows that the filter and the view let through take part, so they fill the ten.
            within = self.table("vectors").join(rows.select("write_cursor"), "write_cursor", "left_semi")
            q = self.spark.createDataFrame([("q", self._centre(self.embedder([query])[0]))], "query_id string, q array<float>")
            near = vector.knn_two_phase(within, q, self.dim, max(10, limit), None, key="write_cursor", vector="centred").select("query_id", "write_cursor", "rank")
            arms = {"vector": near.join(rows, "write_cursor"), **arms}
        if o.use_graph_arm:
            placed = hits.withColumnRenamed("doc", "write_cursor").select("query_id", "write_cursor", "score")
            edge_hits = textindex.top(placed.join(facts.select("write_cursor"), "write_cursor", "left_semi"), graph.SEEDS, "write_cursor")
            node_hits = textindex.top(placed.join(rows.select("write_cursor"), "write_cursor", "left_semi"), graph.SEEDS, "write_cursor").join(rows.select("write_cursor", "logical_id"), "write_cursor")
            started = graph.seeds(edge_hits.select("query_id", "write_cursor"), node_hits.select("query_id", "logical_id"), self.table("nodes"), self.table("edges"), now)
            reached = graph.graph_arm(started, self.table("nodes"), self.table("edges"), 2, now)
            arms["graph"] = reached.join(rows.drop("confidence"), "logical_id").withColumn("source_id", F.coalesce("via", "source_id")).drop("via")
        fused = fusion.fuse(arms, weigh_confidence=o.importance)
        if o.recency:
            fused = fusion.with_recency(fused)
        if o.importance:
            fused = fused.withColumn("score", F.col("score") * F.coalesce("importance", F.lit(1.0)))
        ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*fusion.fused_order(list(arms)))))
        if o.rerank_depth and o.scorer is not None:
            ranked = self._rerank(ranked, query, o.scorer, o.rerank_depth, o.alpha)
        return ranked.filter(F.col("rank") <= limit).withColumn("id", fusion.identity()).drop("__arm"), arms, dropped

    def _centre(self, v: list[float]) -> list[float]:
        """A vector less the pinned mean, if there is one."""
        return [float(x) for x in v[: self.dim]] if self.meta["mean"] is None else [float(x) - m for x, m in zip(v, self.meta["mean"])]

    def _rerank(self, ranked: DataFrame, query: str, scorer, depth: int, alpha: float) -> DataFrame:
        @F.pandas_udf("double")
        def logits(bodies):
            import pandas as pd

            return pd.Series(scorer(query, bodies.tolist()), dtype="float64")

        pool = ranked.filter(F.col("rank") <= depth).withColumn("logit", logits("body"))
        tail = ranked.filter(F.col("rank") > depth).withColumn("logit", F.lit(None).cast("double"))
        return fusion.blend(pool.unionByName(tail), "logit", alpha, depth)

    def rerank(self, query: str, passages: list[str], scorer: Callable[[str, list[str]], list[float]], alpha: float = 0.3, pool_n: int = 50) -> DataFrame:
        """The caller's passages in a new order."""
        rows = self.spark.createDataFrame([("q", i, p, 1.0 / (fusion.RRF_K + i)) for i, p in enumerate(passages, 1)], "query_id string, rank int, body string, score double")
        return self._rerank(rows, query, scorer, pool_n, alpha).orderBy("rank")

    def search_text_only(self, query: str, limit: int = 10, view: ReadView = DEFAULT_VIEW) -> DataFrame:
        asked = self.spark.createDataFrame([("q", query)], "query_id string, text string")
        rows = view.for_search().of(self.table("nodes"), self.now())
        return textindex.top(textindex.bm25(rows, "write_cursor", F.col("body"), asked, Okapi(1.2, 0.75), every=False, stems=True), limit).join(rows.withColumnRenamed("write_cursor", "doc"), "doc").orderBy("rank")

    def search_projected_text(self, query: str, name: str, limit: int = 10, where: Filter = Filter()) -> DataFrame:
        if name not in self._registry() or "searchable" not in self._registry()[name].roles:
            raise InvalidArgument(f"no searchable projection {name!r}")
        asked = self.spark.createDataFrame([("q", query)], "query_id string, text string")
        seen = where.for_search(DEFAULT_VIEW.of(self.table("nodes"), self.now()), self.table("attributes")).select("write_cursor")
        docs = self.table("attributes").filter(F.col("attr_name") == name).join(seen, "write_cursor", "left_semi")
        return textindex.top(textindex.bm25(docs, "write_cursor", F.col("attr_value"), asked, Okapi(1.2, 0.75), every=False, stems=True), limit).orderBy("rank")

    def bm25f_search(self, query: str, weights: dict[str, float] | None = None, limit: int = 10) -> DataFrame:
        asked = self.spark.createDataFrame([("q", query)], "query_id string, text string")
        rows = DEFAULT_VIEW.of(self.table("nodes"), self.now())
        status = F.coalesce(F.get_json_object("body", "$.status"), F.lit(""))
        return textindex.top(textindex.bm25_fielded(rows, "write_cursor", {"kind": F.col("kind"), "body": F.col("body"), "status": status}, asked, Okapi(1.2, 0.75, weights or {}), stems=True), limit).orderBy("rank")

    # -- graph

    def neighbors(self, logical_id: str, depth: int = 1, direction: str = "outgoing") -> DataFrame:
        if "\x1e" in logical_id:
            raise InvalidArgument("an id has no record separator")
        return graph.neighbours(self.table("nodes"), self.table("edges"), self.spark.createDataFrame([(logical_id,)], "root string"), depth, direction, self.now())

    def search_expand(self, query: str, depth: int = 1, search_limit: int = 10) -> DataFrame:
        hits = self.search(query, limit=search_limit).filter("logical_id IS NOT NULL").select("query_id", "logical_id")
        return graph.search_expand(hits, self.table("nodes"), self.table("edges"), depth, self.now())

    # -- projections and vectors

    def _registry(self) -> dict[str, Projection]:
        return {n: Projection(n, frozenset(p["roles"]), tuple(p["source"]), p["full_text"], p["vector"]) for n, p in self.meta["registry"].items()}

    def configure_projections(self, wanted: list[Projection], drop: tuple[str, ...] = ()) -> projections.Difference:
        """Declare, backfill what is new, drop what is named."""
        change = projections.configure(self._registry(), wanted, drop, self.embedder is not None and not self.dense_disabled)
        current = self.table("nodes").filter("superseded_at IS NULL AND state = 'active'")
        projections.require_scalars(current, change.registry)
        stored = {n: {"roles": sorted(p.roles), "source": list(p.source), "full_text": p.full_text, "vector": p.vector} for n, p in change.registry.items()}
        self._commit({"attributes": projections.attributes(current, change.registry)}, registry=stored)
        return change

    def projections(self) -> dict[str, Projection]:
        return self._registry()

    def embed(self, text: str) -> list[float]:
        return self.embed_batch_cls([text])[0]

    def embed_batch_cls(self, texts: list[str]) -> list[list[float]]:
        if self.embedder is None:
            raise InvalidArgument("no embedder was given")
        return self.embedder(texts)

    def project_vectors(self) -> int:
        """Embed the current nodes that have no vector; by partition on the executors.  Rows of kind graph are found by text alone."""
        embedder, dim = self.embedder, self.dim
        if embedder is None:
            raise InvalidArgument("no embedder was given")
        missing = self.table("nodes").filter("superseded_at IS NULL AND state = 'active' AND coalesce(row_kind, 'leaf') != 'graph'").join(self.table("vectors").select("write_cursor"), "write_cursor", "left_anti")

        @F.pandas_udf("array<float>")
        def embedded(bodies):
            import pandas as pd

            return pd.Series([[float(x) for x in v[:dim]] for v in embedder(bodies.tolist())])

        fresh = missing.select("write_cursor", embedded("body").alias("embedding"), F.lit("").alias("source_type"), "kind", "created_at", "status")
        self._commit(appended={"vectors": self._coded(fresh, self.meta["mean"])})
        n = self.table("vectors").count()
        if self.meta["mean"] is None and n >= vector.PIN_AFTER:
            first = vector.pinned_mean(self.table("vectors"), "write_cursor", vector.PIN_AFTER).first()
            self._requantise(list(first.m))
        return n

    def _coded(self, rows: DataFrame, mean: list[float] | None) -> DataFrame:
        """Vectors with what is searched: themselves less the mean, and the sign bits of that."""
        m = None if mean is None else F.array(*[F.lit(float(x)) for x in mean])
        less = F.col("embedding") if m is None else F.zip_with(F.col("embedding"), m, lambda x, y: (x - y).cast("float"))
        return rows.withColumn("centred", less).withColumn("bits", vector.sign_words(F.col("centred"), self.dim))

    def _requantise(self, mean: list[float]) -> None:
        """Store a mean, and all vectors less it with new sign bits."""
        self._commit({"vectors": self._coded(self.table("vectors"), mean)}, mean=mean)

    def recompute_mean(self) -> DataFrame:
        """(pos, mean) of all vectors, stored; vectors are quantised again by it."""
        means = vector.mean_vector(self.table("vectors")).orderBy("pos").collect()
        if means:
            self._requantise([r["mean"] for r in means])
        return self.spark.createDataFrame([(r.pos, r["mean"]) for r in means], "pos int, mean double")

    def projection_status(self) -> DataFrame:
        return projections.readiness(self.table("nodes").filter("superseded_at IS NULL"), self.table("vectors"), self.table("vectors").limit(0))

    embedding_readiness = projection_status

    def rebuild_projections(self) -> None:
        """Derive attributes, and vectors if there is an embedder, again from the active canonical rows alone."""
        self._commit({"attributes": projections.attributes(self.table("nodes").filter("superseded_at IS NULL AND state = 'active'"), self._registry()), "vectors": self.table("vectors").limit(0)})
        if self.embedder is not None:
            self.project_vectors()

    def verify_embedder(self, probes: DataFrame, fresh: DataFrame) -> DataFrame:
        """Probe results; a failed one disables the vector arm and leaves text search."""
        result = vector.equivalence(probes, fresh, self.dim)
        self.dense_disabled_reason = None if result.filter("NOT equivalent").isEmpty() else "probe vectors differ"
        self.counters["vector_equivalence_refusals"] += self.dense_disabled
        return result

    @property
    def dense_disabled(self) -> bool:
        return self.dense_disabled_reason is not None

    # -- providers

    def ingest_with_extractor(self, command: list[str], documents: DataFrame, timeout: float = 60.0) -> dict:
        """Entities become nodes, relations facts; a restated fact replaces the former."""
        staged = providers.extract(documents, command, timeout).persist()
        try:
            receipt = self.write(nodes=providers.staged_nodes(staged))
            facts = providers.staged_edges(staged)
            cursor = self.meta["cursor"] + 1
            self._commit({"edges": providers.merge_facts(self.table("edges"), facts, cursor)}, cursor=cursor)
            return {**receipt, "cursor": cursor}
        finally:
            staged.unpersist()

    def consolidate_with_provider(self, verdicts: DataFrame | None = None) -> DataFrame:
        """Apply keep/invalidate verdicts, by recency unless given, to competing facts; bodies stay."""
        judged = providers.consolidate_by_recency(self.table("edges")) if verdicts is None else verdicts
        ends = judged.filter("verdict = 'invalidate'").select("write_cursor", "new_t_invalid").withColumn("__hit", F.lit(True))
        merged = self.table("edges").join(ends, "write_cursor", "left").withColumn("t_invalid", F.when(F.col("__hit"), F.col("new_t_invalid")).otherwise(F.col("t_invalid"))).drop("new_t_invalid", "__hit")
        self._commit({"edges": merged})
        return judged

    # -- observation

    def enable_telemetry(self, path: str) -> None:
        """Events go to files of JSON lines below ``path``."""
        self.telemetry = Store(self.spark, path)

    def _note(self, event: dict) -> None:
        self.counters["telemetry"] += 1
        self.telemetry.write_new(f"{int(time.time() * 1000):015}-{self.counters['telemetry']:06}-{uuid.uuid4().hex[:8]}.json", json.dumps(event, sort_keys=True) + "\n")

    def _tell(self, query: str, hits: DataFrame) -> None:
        self._count("search")
        if self.telemetry is None:
            return
        self.last_query_id = f"q{self.counters['search']}"
        rows = hits.select("write_cursor", "branch").collect()
        event = {"type": "event", "query_id": self.last_query_id, "schema_version": 1, "query_chars": len(query), "result_ids": [r[0] for r in rows], "arm_of": {str(r[0]): r[1] for r in rows}}
        self._note(event)

    def record_feedback(self, query_id: str, relevant: list[int], irrelevant: list[int], label_source: str) -> None:
        if self.telemetry is None:
            raise InvalidArgument("telemetry is off")
        self._note({"type": "feedback", "query_id": query_id, "relevant_ids": relevant, "irrelevant_ids": irrelevant, "label_source": label_source})

    def _count(self, what: str) -> None:
        self.counters[what] += 1

    def timed(self, what: str, action: Callable[[], object]) -> object:
        """Run an action, count its error if it fails, and note it if it was slow."""
        began = time.perf_counter()
        try:
            return action()
        except Exception as e:
            self.errors_by_code[type(e).__name__] += 1
            raise
        finally:
            ms = (time.perf_counter() - began) * 1000
            if self.slow_threshold_ms is not None and ms > self.slow_threshold_ms:
                self.profile.append((what, ms))

    # -- diagnostics

    def check_integrity(self) -> DataFrame:
        return lifecycle.integrity_findings(self.table("nodes"), self.table("edges"))

    def safe_export(self, out: str) -> dict:
        return corpus.export(self.spark, {t: self.table(t) for t in schema.PUBLIC}, out)

    def trace(self, source_id: str) -> DataFrame:
        return lifecycle.trace_source(source_id, self.table("nodes"), self.table("edges"))

    def dump_schema(self) -> dict[str, str]:
        return {t: self.table(t).schema.simpleString() for t in schema.PUBLIC}

    def dump_row_counts(self) -> DataFrame:
        return lifecycle.row_counts({t: self.table(t) for t in schema.PUBLIC})

    def dump_profile(self) -> dict:
        return {"dimension": self.dim, "embedder": self.embedder is not None, "registry": sorted(self.meta["registry"]), "counters": dict(self.counters)}

    def orphan_provenance(self) -> DataFrame:
        return lifecycle.provenance_census(self.table("nodes").select("source_id", "superseded_at", "logical_id").unionByName(self.table("edges").select("source_id", "superseded_at", "logical_id"))).filter("source_id IS NULL")


def hashing_embedder(dim: int) -> Embedder:
    """The offline default: unit bag-of-words vectors by SHA-1 buckets."""
    import hashlib
    import math
    import re

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in re.findall("[a-z0-9]+", (t or "").lower()):
                v[int(hashlib.sha1(w.encode()).hexdigest(), 16) % dim] += 1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


__all__ = ["Engine", "Explanation", "IllegalTransition", "Options", "hashing_embedder", "replace", "terms"]
