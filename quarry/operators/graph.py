"""Bounded traversal and graph ranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.errors import InvalidArgument
from quarry.operators.prefix import prefix_sum
from quarry.operators.views import active, current, edge_live, valid_at
from quarry.session import cut

MOST_NEIGHBOURS = 50
MOST_DEPTH = 3
#: Seeds of the graph arm from each of the text sources, edge facts and entity nodes.
SEEDS = 10
#: Nodes and edges of a question's graph that one task holds.
MOST_ROWS = 2_000_000


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(a, b, source_id, edge_cursor) in the direction of travel."""
    out = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "source_id", F.col("write_cursor").alias("edge_cursor"))
    back = edges.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), "source_id", F.col("write_cursor").alias("edge_cursor"))
    if direction == "outgoing":
        return out
    if direction == "incoming":
        return back
    if direction == "both":
        return out.unionByName(back)
    raise InvalidArgument(f"no such direction: {direction!r}")


def reach(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, direction: str = "outgoing", now: int = 0) -> DataFrame:
    """(root, id, hop): nodes within ``depth`` hops of each root, at their nearest hop, the root excluded.

    Only live edges and active, current, valid nodes are passed, at every hop.  A hop is one join on the frontier,
    which holds each (root, node) once: what was reached before is anti-joined away, so cycles end.
    """
    if not 1 <= depth <= MOST_DEPTH:
        raise InvalidArgument(f"depth {depth} isn't 1 to {MOST_DEPTH}")
    seen_by = nodes.filter(current() & active() & valid_at(now)) if "superseded_at" in nodes.columns else nodes.filter(active() & valid_at(now))
    alive = seen_by.select(F.col("logical_id").alias("b")).distinct()
    steps = oriented(edges.filter(edge_live(now)), direction).select("a", "b").distinct().join(alive, "b", "left_semi")
    if depth > 1:  # every hop joins these, and each frontier is asked for twice: both are kept, so the plan stays as deep as one hop
        steps = cut(steps)
    start = roots.select(F.col("root"), F.col("root").alias("id")).join(alive.withColumnRenamed("b", "id"), "id", "left_semi").select("root", "id", F.lit(0).alias("hop"))
    if depth > 1:
        start = cut(start)
    found, frontier = start, start
    for hop in range(1, depth + 1):
        following = frontier.select("root", F.col("id").alias("a")).join(steps, "a").select("root", F.col("b").alias("id")).distinct()
        frontier = following.join(found.select("root", "id"), ["root", "id"], "left_anti").withColumn("hop", F.lit(hop))
        if depth > 1:
            frontier = cut(frontier)
        found = found.unionByName(frontier)
    return found.filter("hop > 0")


def neighbours(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, direction: str = "outgoing", now: int = 0, most: int = MOST_NEIGHBOURS) -> DataFrame:
    """(root, id, hop): the nearest ``most`` of each root, by hop and id."""
    order = Window.partitionBy("root").orderBy("hop", "id")
    return reach(nodes, edges, roots, depth, direction, now).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).drop("place")


def search_expand(hits: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int, now: int = 0) -> DataFrame:
    """(query_id, logical_id, origin, hop): hits, and what they lead to that is no hit itself, at its nearest hop."""
    if not 0 <= depth <= MOST_DEPTH:
        raise InvalidArgument(f"depth {depth} isn't 0 to {MOST_DEPTH}")
    own = hits.select("query_id", "logical_id", F.lit("hit").alias("origin"), F.lit(0).alias("hop"))
    if depth == 0:
        return own
    near = neighbours(nodes, edges, hits.select(F.col("logical_id").alias("root")).distinct(), depth, "both", now)
    further = hits.select("query_id", F.col("logical_id").alias("root")).join(near, "root").groupBy("query_id", F.col("id").alias("logical_id")).agg(F.min("hop").alias("hop"))
    return own.unionByName(further.join(hits.select("query_id", "logical_id"), ["query_id", "logical_id"], "left_anti").select("query_id", "logical_id", F.lit("expanded").alias("origin"), "hop"))


def seeds(edge_hits: DataFrame, node_hits: DataFrame, nodes: DataFrame, edges: DataFrame, now: int = 0) -> DataFrame:
    """(query_id, logical_id): endpoints of hit edge facts and hit entity nodes, if active.

    Edge facts with a fallback date or that have ended seed nothing.
    """
    usable = edges.filter(edge_live(now) & ~F.coalesce(F.col("temporal_fallback") == 1, F.lit(False)))
    ends = edge_hits.join(usable, "write_cursor").selectExpr("query_id", "stack(2, from_id, to_id) AS logical_id")
    both = ends.unionByName(node_hits.filter("logical_id IS NOT NULL").select("query_id", "logical_id")).distinct()
    return both.join(nodes.filter(active()).select("logical_id").distinct(), "logical_id", "left_semi").select("query_id", "logical_id")


def graph_arm(seeded: DataFrame, nodes: DataFrame, edges: DataFrame, depth: int = 2, now: int = 0, most: int = MOST_NEIGHBOURS) -> DataFrame:
    """(query_id, logical_id, rank, confidence, via): seeds and what they reach, by hop and id, as the third arm of fusion.

    ``confidence`` and ``via`` are those of the surest live edge that leads to the node at its nearest hop, null confidence
    being 1, and the source of that edge; a seed has 1 and none.
    """
    seeded = cut(seeded)
    near = reach(nodes, edges, seeded.select(F.col("logical_id").alias("root")).distinct(), depth, "both", now)
    reached = seeded.select("query_id", F.col("logical_id").alias("root")).join(near, "root").select("query_id", F.col("id").alias("logical_id"), "hop")
    every = cut(reached.unionByName(seeded.select("query_id", "logical_id", F.lit(0).alias("hop"))).groupBy("query_id", "logical_id").agg(F.min("hop").alias("hop")))
    order = Window.partitionBy("query_id").orderBy("hop", "logical_id")
    first = every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    sure = F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in edges.columns else F.lit(1.0)
    live = edges.filter(edge_live(now)).select("from_id", "to_id", "source_id", sure.alias("sure"))
    led = live.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "source_id", "sure").unionByName(live.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), "source_id", "sure"))
    # An edge led here if its other end was reached one hop earlier.
    before = every.select("query_id", F.col("logical_id").alias("a"), (F.col("hop") + 1).alias("hop"))
    ways = first.filter("hop > 0").select("query_id", F.col("logical_id").alias("b"), "hop").join(led, "b").join(before, ["query_id", "a", "hop"])
    best = ways.groupBy("query_id", F.col("b").alias("logical_id")).agg(F.max(F.struct("sure", "source_id")).alias("w"))
    return first.join(best, ["query_id", "logical_id"], "left").select("query_id", "logical_id", "rank", F.coalesce("w.sure", F.lit(1.0)).alias("confidence"), F.col("w.source_id").alias("via"))


def frontier_stats(considered: DataFrame, resolved: DataFrame) -> DataFrame:
    """(considered, resolved, rate): how many seeds were found active; 0 of 0 is 0."""
    a, b = considered.agg(F.count(F.lit(1)).alias("considered")), resolved.agg(F.count(F.lit(1)).alias("resolved"))
    return a.crossJoin(b).withColumn("rate", F.when(F.col("considered") > 0, F.col("resolved") / F.col("considered")).otherwise(0.0))


def entity_graph(mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (question, entity) and undirected edges (question, a, b), a < b, of extractions.

    ``mentions`` has (question, passage, entity), ``relations`` (question, subject, object), names canonical.
    """
    pairs = relations.filter("subject != object AND subject != '' AND object != ''").select("question", F.least("subject", "object").alias("a"), F.greatest("subject", "object").alias("b")).distinct()
    ends = relations.selectExpr("question", "stack(2, subject, object) AS entity").filter("entity != ''")
    return mentions.filter("entity != ''").select("question", "entity").unionByName(ends).distinct(), pairs


def seed_weights(mentions: DataFrame, ranked: DataFrame, passages: DataFrame, seed_k: int = 10) -> DataFrame:
    """(question, entity, weight): entities of the ``seed_k`` best passages, rare ones heavier.

    ``ranked`` has (question, passage, rank), ``passages`` (question, n_passages).
    """
    df = mentions.select("question", "passage", "entity").distinct()
    spread = df.groupBy("question", "entity").agg(F.count(F.lit(1)).alias("df"))
    best = df.join(ranked.filter(F.col("rank") <= seed_k).select("question", "passage"), ["question", "passage"], "left_semi").select("question", "entity").distinct()
    w = F.log((F.greatest("n_passages", F.lit(1)) + 1) / (F.col("df") + 0.5))
    return best.join(spread, ["question", "entity"]).join(passages, "question").select("question", "entity", F.when(w > 0, w).otherwise(1e-6).alias("weight"))


def personalised_pagerank(nodes: DataFrame, edges: DataFrame, weights: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, rounds: int = 1000, most_rows: int = MOST_ROWS) -> DataFrame:
    """(question, entity, mass) per question by power iteration to convergence.

    Mass teleports, and leaves nodes without edges, to the seeds; it has settled when a round moves less than ``tolerance`` per
    node.  The graph of a question with at most ``most_rows`` nodes and edges goes to one task; the graphs of larger ones are
    iterated together, a join and a sum a round.  A question without weight has mass 0.
    """
    size = nodes.select("question").unionByName(edges.select("question")).groupBy("question").agg(F.count(F.lit(1)).alias("rows"))
    large = cut(size.filter(F.col("rows") > most_rows).select("question"))
    if large.isEmpty():
        return _small_pagerank(nodes, edges, weights, alpha, tolerance, rounds)
    small = [t.join(large, "question", "left_anti") for t in (nodes, edges, weights)]
    rest = [t.join(large, "question", "left_semi") for t in (nodes, edges, weights)]
    return _small_pagerank(*small, alpha, tolerance, rounds).unionByName(_large_pagerank(*rest, alpha, tolerance, rounds))


def _large_pagerank(nodes: DataFrame, edges: DataFrame, weights: DataFrame, alpha: float, tolerance: float, rounds: int) -> DataFrame:
    links = edges.select("question", "a", "b").unionByName(edges.select("question", F.col("b").alias("a"), F.col("a").alias("b")))
    degree = links.groupBy("question", "a").agg(F.count(F.lit(1)).alias("degree"))
    ways = cut(links.join(degree, ["question", "a"]).select("question", "a", "b", "degree"))
    seeds = nodes.select("question", "entity").join(weights, ["question", "entity"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    totals = seeds.groupBy("question").agg(F.sum("weight").alias("total"), F.count(F.lit(1)).alias("n"))
    homes = seeds.join(totals, "question").join(degree.select("question", F.col("a").alias("entity"), F.lit(1).alias("linked")), ["question", "entity"], "left")
    start = 1 / F.col("n")
    state = cut(homes.filter("total > 0").select("question", "entity", F.col("linked").isNull().alias("stuck"), (F.col("weight") / F.col("total")).alias("home"), (start + 1).alias("old"), start.alias("mass")))
    settled = homes.filter("total <= 0").select("question", "entity", F.lit(0.0).alias("mass"))
    moved = F.sum(F.abs(F.col("mass") - F.col("old")))
    for _ in range(rounds):
        # A question that has settled keeps its last two masses, and so stays settled.
        facts = cut(state.groupBy("question").agg(F.sum(F.when(F.col("stuck"), F.col("mass")).otherwise(0.0)).alias("held"), (moved >= F.count(F.lit(1)) * tolerance).alias("moving")))
        if facts.filter("moving").isEmpty():
            break
        arrived = state.select("question", F.col("entity").alias("a"), "mass").join(ways, ["question", "a"]).groupBy("question", F.col("b").alias("entity")).agg(F.sum(F.col("mass") / F.col("degree")).alias("got"))
        after = (1 - alpha + alpha * F.col("held")) * F.col("home") + alpha * F.coalesce("got", F.lit(0.0))
        both = state.join(facts, "question").join(arrived, ["question", "entity"], "left")
        state = cut(both.select("question", "entity", "stuck", "home", F.when(F.col("moving"), F.col("mass")).otherwise(F.col("old")).alias("old"), F.when(F.col("moving"), after).otherwise(F.col("mass")).alias("mass")))
    return state.select("question", "entity", "mass").unionByName(settled)


def _small_pagerank(nodes: DataFrame, edges: DataFrame, weights: DataFrame, alpha: float, tolerance: float, rounds: int) -> DataFrame:
    tagged = nodes.select("question", F.lit("n").alias("t"), F.col("entity").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w"))
    tagged = tagged.unionByName(edges.select("question", F.lit("e").alias("t"), "a", "b", F.lit(0.0).alias("w"))).unionByName(weights.select("question", F.lit("s").alias("t"), F.col("entity").alias("a"), F.lit(None).cast("string").alias("b"), F.col("weight").alias("w")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.sort(pdf.loc[pdf.t == "n", "a"].to_numpy(dtype=object))
        at = {v: i for i, v in enumerate(names)}
        ends = [pdf.loc[pdf.t == "e", c].map(at).to_numpy(dtype=np.int64) for c in ("a", "b")]
        source, target = np.concatenate(ends), np.concatenate(ends[::-1])
        degree = np.bincount(source, minlength=len(names))
        home = np.zeros(len(names))
        seeds = pdf[(pdf.t == "s") & pdf.a.isin(at)]
        home[seeds["a"].map(at).to_numpy(dtype=np.int64)] = seeds["w"].to_numpy(dtype=np.float64)
        mass = np.zeros(len(names))
        if home.sum() > 0:
            home, mass = home / home.sum(), np.full(len(names), 1 / len(names))
            for _ in range(rounds):
                flow = np.bincount(target, weights=(mass / np.maximum(degree, 1))[source], minlength=len(names))
                after = (1 - alpha + alpha * mass[degree == 0].sum()) * home + alpha * flow
                moved, mass = np.abs(after - mass).sum(), after
                if moved < len(names) * tolerance:
                    break
        return pd.DataFrame({"question": pdf["question"].iloc[0], "entity": names, "mass": mass})

    return tagged.groupBy("question").applyInPandas(one, "question string, entity string, mass double")


def passage_scores(mentions: DataFrame, mass: DataFrame) -> DataFrame:
    """(question, passage, score): the mass of the entities a passage mentions."""
    return mentions.select("question", "passage", "entity").distinct().join(mass, ["question", "entity"]).groupBy("question", "passage").agg(F.sum("mass").alias("score"))


def ranked_passages(passages: DataFrame, score: str) -> DataFrame:
    """(question, passage, rank): all passages of each question, a missing score being 0, ties by passage; a question of any size is numbered in blocks."""
    rows = passages.select("question", "passage", (-F.coalesce(score, F.lit(0.0))).alias("__low"))
    return prefix_sum(rows, ["question"], ["__low", "passage"], F.lit(1), "rank").select("question", "passage", "rank")


def chains(documents: DataFrame) -> DataFrame:
    """(from_id, to_id, kind): documents linked to a parent that is there too, by their relation tag, else linked."""
    relation = F.coalesce(F.try_element_at(F.transform(F.filter("tags", lambda t: t.startswith("relation:")), lambda t: F.substring(t, 10, 100)), F.lit(1)), F.lit("linked"))
    there = documents.select(F.col("doc_id").alias("parent_doc_id")).distinct()
    return documents.filter("parent_doc_id IS NOT NULL").join(there, "parent_doc_id").select(F.col("parent_doc_id").alias("from_id"), F.col("doc_id").alias("to_id"), relation.alias("kind")).distinct()


Batches = Iterator[pd.DataFrame]
