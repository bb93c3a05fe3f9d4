"""Problem 2: the k most similar vectors of every vector, by adaptive dimension scan over inverted lists.

Vectors are unit length, so the smaller the distance the larger the cosine.  A coarse quantiser is
fitted on a bounded sample; every vector lies in the list of its nearest centroid and, as a query,
also probes the lists whose centroids are nearly as near.  Lists grow in number with the collection: beyond
what one quantiser may have, each list of a coarse one is divided by a quantiser of its own, fitted where
the list is.  Rows reach a task in order of their lists: it holds one list's candidates, or one quantiser, and
the queries pass by.  It rotates the
vectors by one random orthogonal matrix and lays them out in column blocks; after each block the
partial distance over the d columns read so far, scaled by D / d, is an estimate of the distance,
and a candidate is abandoned when the hypothesis "it is nearer than the k-th found so far" is
rejected at that estimate.  Candidates that survive all blocks have their exact distance.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.session import cut

#: Bounds of what the driver, or the task of one coarse list, fits: sampled vectors and centroids.
MOST_SAMPLED, MOST_LISTS = 32_768, 4_096
#: Ends of the column blocks as fractions of the dimension.
BLOCKS = (1 / 6, 1 / 3, 2 / 3, 1.0)
#: Rows of one list that a task holds as candidates; larger lists are cut.
UNIT_ROWS = 8_192
#: Rows with a vector that a task gives away at once, and numbers of neighbours.
EMITTED, EMITTED_PAIRS = 4_096, 65_536
#: Queries and candidates compared at once; the first few candidates of a list are compared in full, for a k-th distance to test against.
QUERY_STRIP, FIRST_CANDIDATES, CANDIDATE_STRIP = 512, 48, 1_024


@dataclass(frozen=True)
class Scan:
    """Parameters of the search.

    A list is probed if its centroid is at most ``1 + slack`` times as far as the nearest one, up to
    ``most_probes`` lists; ``epsilon`` is the test's strictness (the chance to abandon a true neighbour
    falls exponentially with its square); ``per_list`` the rows a list should have.
    """

    k: int = 10
    slack: float = 0.2
    most_probes: int = 16
    epsilon: float = 3.0
    per_list: int = 64
    seed: int = 7


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(k, v): rows whose vector has exactly ``dim`` finite numbers, not all zero; null keys left out."""
    v = F.col(f"`{vector}`").cast("array<float>")
    top, low = F.array_max(v), F.array_min(v)
    finite = ~F.isnan(top) & (F.abs(top) < float("inf")) & (F.abs(low) < float("inf"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("k"), v.alias("v"))
    return rows.filter(F.col("k").isNotNull() & (F.size("v") == dim)).filter((F.size(F.array_compact("v")) == dim) & finite & ((F.array_max("v") != 0) | (F.array_min("v") != 0)))


def distinct_vectors(rows: DataFrame, copies: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of equal vectors only the ``copies`` smallest keys as (k, v); these as (k, c1, c2, place); all keys as (k, c1, c2).

    Vectors move once, combined before the shuffle; keys and 128-bit content hashes rank the copies,
    where each input partition already drops what is beyond the limit.
    """
    hashed = rows.withColumn("c1", F.xxhash64(F.lit(1), "v")).withColumn("c2", F.xxhash64(F.lit(2), "v"))
    keys = hashed.select("c1", "c2", "k").distinct()
    first = keys.withColumn("place", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("k"))).filter(F.col("place") <= copies)
    vectors = hashed.groupBy("c1", "c2").agg(F.first("v").alias("v"))
    return first.join(vectors, ["c1", "c2"]).select("k", "v"), first, keys


def fit(sample: np.ndarray, lists: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids by spherical k-means; an empty list takes the sampled vector that fits its own worst."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(sample)))
    centroids = sample[np.sort(rng.choice(len(sample), lists, replace=False))].copy()
    for _ in range(rounds):
        near = np.empty(len(sample), dtype=np.int64)
        fits = np.empty(len(sample), dtype=np.float32)
        for a in range(0, len(sample), 4096):
            sims = sample[a : a + 4096] @ centroids.T
            near[a : a + 4096] = sims.argmax(1)
            fits[a : a + 4096] = sims.max(1)
        order = np.argsort(near, kind="stable")
        starts = np.searchsorted(near[order], np.arange(lists))
        sizes = np.diff(np.append(starts, len(sample)))
        full = sizes > 0
        sums = np.add.reduceat(sample[order], starts[full], axis=0)
        centroids[full] = sums
        empty = np.flatnonzero(~full)
        centroids[empty] = sample[np.argsort(fits)[: len(empty)]]
        norms = np.linalg.norm(centroids, axis=1, keepdims=True)
        centroids /= np.where(norms > 0, norms, 1)
    return centroids.astype(np.float32)


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def unit_rows(flat: np.ndarray, dim: int) -> np.ndarray:
    """Vectors that lie one after another as unit rows; scaled by their largest entry first, so squares can't overflow."""
    rows = flat.reshape(-1, dim)
    out = np.empty(rows.shape, dtype=np.float32)
    for a in range(0, len(rows), 2048):
        part = rows[a : a + 2048].astype(np.float64)
        part /= np.abs(part).max(axis=1, keepdims=True)
        out[a : a + 2048] = part / np.linalg.norm(part, axis=1, keepdims=True)
    return out


def scan_list(queries: np.ndarray, query_ids: np.ndarray, candidates: np.ndarray, candidate_ids: np.ndarray, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(squared distances, ids), each (queries, k), of rotated unit vectors; missing ones inf and -1.

    A candidate with the query's own id is none.
    """
    dim, k = queries.shape[1], scan.k
    ends = [max(1, round(dim * b)) for b in BLOCKS]
    limits = np.array([(1 + scan.epsilon / np.sqrt(d)) ** 2 * d / dim if d < dim else 1.0 for d in ends], dtype=np.float32)
    best = np.full((len(queries), k), np.inf, dtype=np.float32)
    found = np.full((len(queries), k), -1, dtype=np.int64)
    blocks = list(zip([0, *ends[:-1]], ends))
    q_norms = [np.einsum("ij,ij->i", queries[:, a:b], queries[:, a:b]) for a, b in blocks]
    c_norms = [np.einsum("ij,ij->i", candidates[:, a:b], candidates[:, a:b]) for a, b in blocks]
    for q0 in range(0, len(queries), QUERY_STRIP):
        strip = slice(q0, q0 + QUERY_STRIP)
        q, ids = queries[strip], query_ids[strip]
        for c0 in [0, *range(FIRST_CANDIDATES, len(candidates), CANDIDATE_STRIP)]:
            part = slice(c0, c0 + (CANDIDATE_STRIP if c0 else FIRST_CANDIDATES))
            c, names = candidates[part], candidate_ids[part]
            worst = best[strip][:, -1]
            a, b = blocks[0]
            partial = q_norms[0][strip][:, None] + c_norms[0][part][None, :] - 2 * (q[:, a:b] @ c[:, a:b].T)
            partial[ids[:, None] == names[None, :]] = np.inf
            qi, ci = np.nonzero(partial <= (worst * limits[0])[:, None])
            so_far = partial[qi, ci]
            for n in range(1, len(blocks)):
                a, b = blocks[n]
                if len(qi) > 0.2 * partial.size:  # few abandoned: the block as one product
                    more = (q[:, a:b] @ c[:, a:b].T)[qi, ci]
                else:
                    more = np.concatenate([np.einsum("ij,ij->i", q[qi[i : i + 8192], a:b], c[ci[i : i + 8192], a:b]) for i in range(0, len(qi), 8192)]) if len(qi) else so_far
                so_far = so_far + q_norms[n][strip][qi] + c_norms[n][part][ci] - 2 * more
                keep = (so_far <= worst[qi] * limits[n]) & np.isfinite(so_far)
                qi, ci, so_far = qi[keep], ci[keep], so_far[keep]
            if not len(qi):
                continue
            order = np.lexsort((names[ci], so_far, qi))
            qi, ci, so_far = qi[order], ci[order], so_far[order]
            place = np.arange(len(qi)) - np.searchsorted(qi, qi, "left")
            top = place < k
            new_d = np.full((len(q), k), np.inf, dtype=np.float32)
            new_i = np.full((len(q), k), -1, dtype=np.int64)
            new_d[qi[top], place[top]], new_i[qi[top], place[top]] = so_far[top], names[ci[top]]
            all_d, all_i = np.hstack([best[strip], new_d]), np.hstack([found[strip], new_i])
            take = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best[strip], found[strip] = np.take_along_axis(all_d, take, 1), np.take_along_axis(all_i, take, 1)
    return best, found


def _nearest_lists(unit: np.ndarray, centroids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(lists, distances), each (rows, probes), nearest first."""
    dist = np.sqrt(np.maximum(0, 2 - 2 * (unit @ centroids.T)))
    probes = min(most, len(centroids))
    near = np.argpartition(dist, probes - 1, axis=1)[:, :probes] if probes < len(centroids) else np.tile(np.arange(len(centroids)), (len(unit), 1))
    far = np.take_along_axis(dist, near, 1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)


def _draw(ks: np.ndarray, salt: int) -> np.ndarray:
    """31 bits of each key, which depend on all its bits, so that no pattern of keys draws all rows or puts them in one part."""
    z = ks.astype(np.uint64) + np.uint64(salt)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(33)).astype(np.int64)


def _units(row: np.ndarray, lists: np.ndarray, own: np.ndarray, ks: np.ndarray, parts: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """(row, unit, is candidate, is query) of rows that go to lists, ``own`` where they lie in them too.

    A list cut into p parts is p * p units, one for each pair of a part of candidates and a part of queries.
    """
    cuts = parts[lists]
    at = np.repeat(np.arange(len(row)), cuts)
    s = np.arange(len(at)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
    mine = (_draw(ks, 1)[row] % cuts)[at]
    base, held = (first + lists[at]) << 32, own[at]
    a, b = held, ~held | (s != mine)
    unit = np.concatenate([(base + (mine << 16) + s)[a], (base + (s << 16) + mine)[b]])
    candidate = np.concatenate([np.ones(a.sum(), bool), np.zeros(b.sum(), bool)])
    query = np.concatenate([(s == mine)[a], np.ones(b.sum(), bool)])
    return row[np.concatenate([at[a], at[b]])], unit, candidate, query


_SPREAD = "u long, k long, cand boolean, query boolean, b binary"


def _spread(unit: np.ndarray, ks: np.ndarray, row: np.ndarray, lists: np.ndarray, own: np.ndarray, parts: np.ndarray, names: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows of ``_units`` with their vectors, in frames of about ``EMITTED`` rows however many lists and parts they go to.

    ``names`` are the numbers by which the lists are known outside.
    """
    piece = np.cumsum(2 * parts[lists]) // EMITTED
    for s in np.split(np.arange(len(row)), np.flatnonzero(np.diff(piece)) + 1):
        at, no, cand, query = _units(row[s], lists[s], own[s], ks, parts, 0)
        yield pd.DataFrame({"u": (names[no >> 32] << 32) + (no & 0xFFFFFFFF), "k": ks[at], "cand": cand, "query": query, "b": [r.tobytes() for r in unit[at]]})


def _runs(*columns: np.ndarray) -> Iterator[slice]:
    """Stretches of rows that are equal in all columns."""
    changes = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
    edges = [0, *changes.tolist(), len(columns[0])]
    return (slice(a, b) for a, b in zip(edges, edges[1:]) if a < b)


def _one_level(searched: DataFrame, dim: int, centroids: np.ndarray, parts: np.ndarray, scan: Scan) -> DataFrame:
    fitted = searched.sparkSession.sparkContext.broadcast((centroids, parts))

    def assign(batches):
        centroids, parts = fitted.value
        for batch in batches:
            for a in range(0, len(batch), 2048):
                ks, vs = batch["k"].to_numpy()[a : a + 2048], batch["v"].iloc[a : a + 2048]
                unit = unit_rows(np.concatenate(vs.to_list()), dim)
                near, far = _nearest_lists(unit, centroids, scan.most_probes)
                go = far <= far[:, :1] * (1 + scan.slack) + 1e-6
                go[:, 0] = True
                i, p = np.nonzero(go)
                yield from _spread(unit, ks, i, near[i, p].astype(np.int64), p == 0, parts, np.arange(len(parts)))

    return searched.mapInPandas(assign, _SPREAD)


#: A list within a coarse list that a row may probe: its place there, its distance, into how many parts it is cut.  Before those of a
#: coarse list there is an item with the coarse list's number and no parts.
_PROBE = np.dtype([("list", "<u2"), ("parts", "<u2"), ("d", "<f4")])
_CHOSEN = np.dtype([("list", "<i8"), ("parts", "<i4"), ("own", "<i4")])


def _choice(items: np.ndarray, row: np.ndarray, scan: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(row, probe) of the probes that rows make: those of one level, over all coarse lists together; a row lies in the nearest list of all."""
    head = items["parts"] == 0
    of, at = np.cumsum(head)[~head] - 1, np.flatnonzero(~head)
    row, d = row[at], items["d"][at]
    probes = np.empty(len(at), dtype=_CHOSEN)
    probes["list"] = items["list"][head][of].astype(np.int64) * MOST_LISTS + items["list"][at]
    probes["parts"] = items["parts"][at]
    order = np.lexsort((probes["list"], d, row))
    starts = np.searchsorted(row[order], row[order], "left")
    place = np.arange(len(row)) - starts
    probes["own"][order] = place == 0
    order = order[(place < scan.most_probes) & (d[order] <= d[order][starts] * (1 + scan.slack) + 1e-6)]
    return row[order], probes[order]


def _two_levels(searched: DataFrame, dim: int, coarse: np.ndarray, share: np.ndarray, n: int, scan: Scan) -> DataFrame:
    """Lists within the lists of ``coarse``, which hold the ``share`` of the rows each.

    Each coarse list's quantiser is fitted on a sample of it, of at most ``MOST_SAMPLED`` rows picked by key, with a list for
    every ``per_list`` rows up to ``MOST_LISTS``.  A large coarse list is spread over several tasks, which all get its centroids;
    they come before the list's rows, which pass by in batches however many probe the list.  To choose lists, half-precision
    vectors go to the coarse lists that a row probes; the vectors themselves go to the chosen lists only.
    """
    searched = cut(searched.withColumn("r", F.monotonically_increasing_id()))
    expected = np.maximum(1.0, share * n)
    lists = np.minimum(MOST_LISTS, np.maximum(1, np.ceil(expected / scan.per_list))).astype(np.int64)
    picked = np.minimum(1.0, np.minimum(MOST_SAMPLED, 16 * lists) / expected)
    salts = np.maximum(1, np.ceil(expected / (2 * UNIT_ROWS))).astype(np.int64)
    known = searched.sparkSession.sparkContext.broadcast((coarse, lists, picked, salts))

    def sampled(batches):
        coarse, _, picked, _ = known.value
        for batch in batches:
            for a in range(0, len(batch), 2048):
                ks = batch["k"].to_numpy()[a : a + 2048]
                unit = unit_rows(np.concatenate(batch["v"].iloc[a : a + 2048].to_list()), dim)
                own = _nearest_lists(unit, coarse, 1)[0][:, 0]
                take = np.flatnonzero(_draw(ks, 2) / float(1 << 31) < picked[own])
                yield pd.DataFrame({"c": own[take].astype(np.int64), "b": [r.tobytes() for r in unit[take]]})

    def fine(pdf: pd.DataFrame) -> pd.DataFrame:
        _, lists, picked, salts = known.value
        c = int(pdf["c"].iloc[0])
        sample = np.frombuffer(b"".join(pdf["b"]), dtype=np.float32).reshape(-1, dim)
        centroids = fit(sample, int(lists[c]), scan.seed)
        near = [_nearest_lists(sample[a : a + 2048], centroids, 1)[0][:, 0] for a in range(0, len(sample), 2048)]
        rows = np.bincount(np.concatenate(near), minlength=len(centroids)) / picked[c]
        parts = np.maximum(1, np.ceil(rows / UNIT_ROWS)).astype(np.int64)
        return pd.DataFrame([(c, int(salts[c]), centroids.tobytes(), parts.tobytes())], columns=["c", "salts", "b", "parts"])

    def probe(batches):
        coarse, _, _, salts = known.value
        for batch in batches:
            for a in range(0, len(batch), 2048):
                ks, rs = batch["k"].to_numpy()[a : a + 2048], batch["r"].to_numpy()[a : a + 2048]
                unit = unit_rows(np.concatenate(batch["v"].iloc[a : a + 2048].to_list()), dim)
                near, far = _nearest_lists(unit, coarse, scan.most_probes)
                go = far <= far[:, :1] * (1 + scan.slack) + 1e-6
                go[:, 0] = True
                rows, probes = np.nonzero(go)
                for s in range(0, len(rows), EMITTED):
                    i, p = rows[s : s + EMITTED], probes[s : s + EMITTED]
                    c = near[i, p].astype(np.int64)
                    b = [r.tobytes() for r in unit.astype(np.float16)[i]]
                    yield pd.DataFrame({"c": c, "salt": _draw(ks, 3)[i] % salts[c], "r": rs[i], "own": p == 0, "d": far[i, 0], "b": b})

    def divide(batches):
        at, centroids, parts = -1, None, None
        for batch in batches:
            cs, rs, own, d = batch["c"].to_numpy(), batch["r"].to_numpy(), batch["own"].to_numpy(dtype=bool), batch["d"].to_numpy()
            passing = batch["passing"].to_numpy(dtype=bool)
            for run in _runs(cs, batch["salt"].to_numpy(), passing):
                c = int(cs[run.start])
                if not passing[run.start]:
                    at, centroids = c, np.frombuffer(batch["b"].iloc[run.start], dtype=np.float32).reshape(-1, dim)
                    parts = np.frombuffer(batch["parts"].iloc[run.start], dtype=np.int64)
                    continue
                if at != c:  # a coarse list of which nothing was sampled
                    at, centroids, parts = c, known.value[0][c][None], np.ones(1, dtype=np.int64)
                for a in range(run.start, run.stop, 2048):
                    s = slice(a, min(a + 2048, run.stop))
                    unit = np.frombuffer(b"".join(batch["b"].iloc[s]), dtype=np.float16).reshape(-1, dim).astype(np.float32)
                    near, far = _nearest_lists(unit, centroids, scan.most_probes)
                    go = far <= np.minimum(far[:, 0], d[s])[:, None] * (1 + scan.slack) + 1e-6
                    go[own[s], 0] = True
                    i, p = np.nonzero(go)
                    rows, starts = np.unique(i, return_index=True)
                    items = np.empty(len(i), dtype=_PROBE)
                    items["list"], items["parts"], items["d"] = near[i, p], parts[near[i, p]], far[i, p]
                    heads = np.zeros(len(rows), dtype=_PROBE)
                    heads["list"] = c
                    items, starts = np.insert(items, starts, heads), (starts + np.arange(len(rows))).tolist()
                    yield pd.DataFrame({"r": rs[s][rows], "probes": [items[x:y].tobytes() for x, y in zip(starts, [*starts[1:], len(items)])]})

    def choose(batches):
        rest = None
        for batch in itertools.chain(batches, [None]):
            rows = pd.concat([x for x in (rest, batch) if x is not None]) if rest is not None or batch is not None else []
            if not len(rows):
                continue
            rs = rows["r"].to_numpy()
            whole = len(rs) if batch is None else int(np.searchsorted(rs, rs[-1], "left"))  # more of the last row may come
            rest = rows.iloc[whole:]
            if not whole:
                continue
            given, (names, of) = rows["probes"].iloc[:whole], np.unique(rs[:whole], return_inverse=True)
            row = np.repeat(of, given.str.len().to_numpy(dtype=np.int64) // _PROBE.itemsize)
            row, probes = _choice(np.frombuffer(b"".join(given), dtype=_PROBE), row, scan)
            ends = np.searchsorted(row, np.arange(len(names) + 1)).tolist()
            yield pd.DataFrame({"r": names, "probes": [probes[x:y].tobytes() for x, y in zip(ends, ends[1:])]})

    def assign(batches):
        for batch in batches:
            for a in range(0, len(batch), 2048):
                ks, given = batch["k"].to_numpy()[a : a + 2048], batch["probes"].iloc[a : a + 2048]
                unit = unit_rows(np.concatenate(batch["v"].iloc[a : a + 2048].to_list()), dim)
                row = np.repeat(np.arange(len(given)), given.str.len().to_numpy(dtype=np.int64) // _CHOSEN.itemsize)
                probes = np.frombuffer(b"".join(given), dtype=_CHOSEN)
                names, some, lists = np.unique(probes["list"], return_index=True, return_inverse=True)
                yield from _spread(unit, ks, row, lists, probes["own"] > 0, probes["parts"][some].astype(np.int64), names)

    fitted = searched.mapInPandas(sampled, "c long, b binary").groupBy("c").applyInPandas(fine, "c long, salts long, b binary, parts binary")
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    none = [F.lit(0).cast("long").alias("r"), F.lit(False).alias("own"), F.lit(0.0).alias("d")]
    first = fitted.select("c", each, *none, "b", "parts", F.lit(False).alias("passing"))
    probed = searched.mapInPandas(probe, "c long, salt long, r long, own boolean, d double, b binary")
    both = first.unionByName(probed.withColumns({"parts": F.lit(None).cast("binary"), "passing": F.lit(True)}))
    divided = both.repartition("c", "salt").sortWithinPartitions("c", "salt", "passing").mapInPandas(divide, "r long, probes binary")
    chosen = divided.repartition("r").sortWithinPartitions("r").mapInPandas(choose, "r long, probes binary")
    return searched.join(chosen, "r").select("k", "v", "probes").mapInPandas(assign, _SPREAD)


def _search(spread: DataFrame, dim: int, scan: Scan) -> DataFrame:
    """(k, o, c): of each query in each unit the ``scan.k`` most similar candidates.

    A task gets its units one after another, candidates first; it holds those of one unit, and queries pass by.
    """
    turn = spread.sparkSession.sparkContext.broadcast(rotation(dim, scan.seed))

    def search(batches):
        turned, now = turn.value, None
        held, asked, found = [], [], []

        def ask():
            nonlocal held
            if held and asked:
                held = [tuple(np.concatenate(x) for x in zip(*held))] if len(held) > 1 else held
                queries, ids = (np.concatenate(x) for x in zip(*asked))
                d, others = scan_list(queries, ids, *held[0], scan)
                i, p = np.nonzero(np.isfinite(d))
                found.append((ids[i], others[i, p], 1 - d[i, p].astype(np.float64) / 2))
            asked.clear()

        def given():
            out = pd.DataFrame(dict(zip("koc", (np.concatenate(x) for x in zip(*found)))))
            found.clear()
            return out

        for batch in batches:
            vectors = np.frombuffer(b"".join(batch["b"]), dtype=np.float32).reshape(-1, dim) @ turned
            us, ks, cand, query = batch["u"].to_numpy(), batch["k"].to_numpy(), batch["cand"].to_numpy(dtype=bool), batch["query"].to_numpy(dtype=bool)
            for run in _runs(us):
                if us[run.start] != now:
                    ask()
                    now, held = us[run.start], []
                c, q = run.start + np.flatnonzero(cand[run]), run.start + np.flatnonzero(query[run])
                if len(c):
                    held.append((vectors[c], ks[c]))
                if len(q):
                    asked.append((vectors[q], ks[q]))
                if not cand[run.stop - 1]:  # no more candidates come
                    ask()
                if sum(len(x[0]) for x in found) >= EMITTED_PAIRS:
                    yield given()
        ask()
        if found:
            yield given()

    return spread.repartition("u").sortWithinPartitions("u", F.desc("cand"), "k").mapInPandas(search, "k long, o long, c double")


def nearest(df: DataFrame, key: str, vector: str, dim: int, scan: Scan = Scan()) -> DataFrame:
    """(key, neighbour, cosine, place): the ``scan.k`` most similar other vectors of every usable one.

    ``place`` is 1 for the most similar; ties go to the smaller key.  Unusable rows (wrong length, null,
    NaN or infinite entries, all zero, null key) are left out on both sides.  A key counts once; if it was
    delivered with different vectors, its nearest one counts.  Of vectors equal entry by entry, the
    ``k + 1`` smallest keys are searched; the others' neighbours are the ``k`` smallest, at cosine 1.
    With fewer than ``k`` others there are fewer rows; an empty table gives an empty result.  Other columns
    are ignored, whatever their names.

    The driver holds at most ``MOST_SAMPLED`` sampled vectors to fit at most ``MOST_LISTS`` centroids, and so does
    each task that divides a coarse list; with ``per_list`` rows a list that makes lists for a thousand million
    vectors, beyond which they grow.  All vectors are indexed and all are queries.  A list expected to exceed ``UNIT_ROWS``
    (by its share of the sample) is cut into blocks of candidates and of queries, each pair of which is one task's work.
    """
    rows = usable(df, key, vector, dim)
    searched, first, keys = distinct_vectors(rows, scan.k + 1)
    n = df.count()  # with unusable rows; good enough to choose sizes by, and read from the footers
    lists = int(max(1, 2 ** np.ceil(np.log2(max(1.0, n / scan.per_list)))))
    deep = lists > MOST_LISTS
    if deep:  # a coarse list for every so many lists within it
        lists = int(min(MOST_LISTS, 2 ** np.ceil(np.log2(np.sqrt(lists)))))
    wanted = min(MOST_SAMPLED, max(1_024, 16 * lists))
    share = 1.0 if n <= wanted else wanted / n
    picked = rows.filter(F.pmod(F.xxhash64("k", F.lit(scan.seed)), F.lit(1 << 30)) < int(share * (1 << 30))) if share < 1 else rows
    drawn = picked.select("v").limit(MOST_SAMPLED).toArrow()["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    sample = unit_rows(drawn, dim) if len(drawn) else np.zeros((1, dim), dtype=np.float32)
    centroids = fit(sample, lists, scan.seed)
    held = np.concatenate([np.argmax(sample[a : a + 4096] @ centroids.T, axis=1) for a in range(0, len(sample), 4096)])
    held_share = np.bincount(held, minlength=len(centroids)) / len(sample)
    parts = np.maximum(1, np.ceil(held_share * n / UNIT_ROWS)).astype(np.int64)

    spread = _two_levels(searched, dim, centroids, held_share, n, scan) if deep else _one_level(searched, dim, centroids, parts, scan)
    scanned = _search(spread, dim, scan).groupBy("k", "o").agg(F.max("c").alias("c"))
    # Keys beyond the k + 1 smallest of equal vectors.
    crowded = first.filter(F.col("place") == scan.k + 1).select("c1", "c2", F.col("k").alias("last"))
    rest = keys.join(crowded, ["c1", "c2"]).filter(F.col("k") > F.col("last")).select("k", "c1", "c2")
    nearest_copies = first.filter(F.col("place") <= scan.k).select("c1", "c2", F.col("k").alias("o"))
    also = rest.join(nearest_copies, ["c1", "c2"]).select("k", "o", F.lit(1.0).alias("c"))
    place = F.row_number().over(Window.partitionBy("k").orderBy(F.col("c").desc(), F.col("o")))
    ranked = scanned.unionByName(also).withColumn("place", place).filter(F.col("place") <= scan.k)
    return ranked.select(F.col("k").alias(key), F.col("o").alias("neighbour"), F.col("c").alias("cosine"), "place")
