"""Problem 3: groups of near-duplicate texts by deletion-variant signatures.

A text's signature has ``segments * width`` min-hashes of its word shingles; two texts agree in a
position with the probability of their Jaccard similarity.  The signature is cut into few segments:
if two signatures differ in fewer than twice as many positions as there are segments, some segment
differs in at most one (pigeonhole).  Each segment is indexed once per position with that position as
a wildcard, so segments that differ in at most one position share a variant; an equality join of
variants finds the candidates, which are verified on the full shingle sets.

A position holds a whole 32-bit min-hash, not one bit of it.  At similarity 0.6 a fifth of all single
bits differ, so segments of bits short enough to survive would be shared by everybody; whole values
keep the method's guarantee, counted in positions, and make it selective.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.components import components
from quarry.operators.prefix import prefix_sum
from quarry.session import cut

#: A variant that more rows than this share is cut into pieces of about this size.
BUCKET_ROWS = 50_000
#: Share of the texts on which such variants are recognised, and how many of them are broadcast; more are joined.
HOT_SAMPLE, FEW_HOT = 64, 1_000_000
#: Up to so many keys are broadcast to fetch texts; more are joined by shuffling.
FEW_KEYS = 50_000
_WORD = re.compile(r"[^\W_]+")
_GOLDEN, _MIX_A, _MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@dataclass(frozen=True)
class Signature:
    """``segments`` segments of ``width`` positions over shingles of ``words`` words; ``similarity`` is the least of a link.

    With 16 segments of 4, signatures that agree in 33 of 64 positions are found for certain; a pair at
    similarity 0.6 is missed with probability 3e-5, one at 0.8 with 1e-12.  ``bits`` is what a position keeps of
    its min-hash: with 1 it is a single bit, and positions agree by chance in half the cases.

    ``deviations`` is how far below its expectation the agreement of two sketches may lie before a pair is dropped
    unverified: at 4.4 standard deviations a pair at the least similarity is lost with probability 6e-6, a fifth of what
    the signatures lose.  Without (None) every pair whose sizes allow it is verified on its texts.
    """

    words: int = 5
    similarity: float = 0.8
    segments: int = 16
    width: int = 4
    bits: int = 32
    deviations: float | None = 4.4
    seed: int = 11


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    h = (h ^ (h >> np.uint64(30))) * _MIX_A
    h = (h ^ (h >> np.uint64(27))) * _MIX_B
    return h ^ (h >> np.uint64(31))


class _Words:
    """64-bit hashes of words, remembered up to a bound."""

    def __init__(self, most: int = 1 << 20):
        import xxhash

        self.hash, self.known, self.most = xxhash.xxh64_intdigest, {}, most

    def of(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > self.most:
            known.clear()
        for w in _WORD.findall(text.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = self.hash(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingle_sets(texts: pd.Series, words: int, table: _Words) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its sequences of ``words`` words (runs of letters and digits, lower case)."""
    out = []
    for text in texts:
        w = table.of(text) if text else np.empty(0, dtype=np.uint64)
        n = len(w) - words + 1
        if n <= 0:
            out.append(np.empty(0, dtype=np.uint64))
            continue
        h = np.zeros(n, dtype=np.uint64)
        for i in range(words):
            h = _mix((h + _GOLDEN) ^ w[i : i + n])
        out.append(np.unique(h))
    return out


def content_hash(shingles: np.ndarray, which: int) -> int:
    """Order-free hash of a non-empty shingle set."""
    return int(_mix(shingles + _GOLDEN * np.uint64(which)).sum(dtype=np.uint64).view(np.int64))


class _Signer:
    """Variants of shingle sets: per segment and wildcard one hash of the other positions."""

    def __init__(self, s: Signature):
        rng = np.random.default_rng(s.seed)
        self.shape, self.n, self.kept = (s.segments, s.width), s.segments * s.width, np.uint64((1 << s.bits) - 1)
        self.odd = rng.integers(0, 1 << 63, (2, self.n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salt = rng.integers(0, 1 << 63, (2, *self.shape), dtype=np.uint64)

    def variants(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, segments * width) variants of non-empty sets, and (texts, 2) words of the lowest two bits of the first 64 positions."""
        flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
        least = np.empty((len(sets), self.n), dtype=np.uint64)
        for p in range(self.n):
            h = flat * self.odd[0, p]
            h ^= h >> np.uint64(32)
            h *= self.odd[1, p]
            h >>= np.uint64(32)
            least[:, p] = np.minimum.reduceat(h, starts)
        term = _mix((least & self.kept).reshape(-1, *self.shape) + self.salt[0])
        # A segment's hash is the sum of its terms; leaving one out is the wildcard, named by the salt.
        wild = term.sum(axis=2, dtype=np.uint64)[:, :, None] - term + self.salt[1]
        places = np.arange(min(64, self.n), dtype=np.uint64)
        bits = [(((least[:, :64] >> np.uint64(b)) & np.uint64(1)) << places).sum(axis=1, dtype=np.uint64) for b in (0, 1)]
        return wild.reshape(len(sets), -1), np.stack(bits, axis=1)


def index(df: DataFrame, key: str, time: str | None, text: str, s: Signature) -> DataFrame:
    """(k, t, c1, c2, size, low, high, variants) of every row: content hashes of the shingle set, its size, two bits of each position, the variants."""

    @F.pandas_udf("c1 long, c2 long, size int, low long, high long, variants array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words, signer = _Words(), _Signer(s)
        for batch in batches:
            out = []
            for a in range(0, len(batch), 256):
                sets = shingle_sets(batch.iloc[a : a + 256], s.words, words)
                full = [x for x in sets if len(x)]
                signed = iter(zip(*(a.view(np.int64) for a in signer.variants(full))) if full else [])
                for x in sets:
                    if not len(x):
                        out.append((0, 0, 0, 0, 0, np.empty(0, dtype=np.int64)))
                        continue
                    variants, bits = next(signed)
                    out.append((content_hash(x, 0), content_hash(x, 1), len(x), *bits.tolist(), variants))
            yield pd.DataFrame(out, columns=["c1", "c2", "size", "low", "high", "variants"])

    t = F.col(f"`{time}`").cast("timestamp") if time else F.lit(None).cast("timestamp")
    rows = df.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("k"), t.alias("t"), sign(F.col(f"`{text}`")).alias("s"))
    return rows.select("k", "t", "s.*")


def hot_variants(classes: DataFrame) -> DataFrame:
    """(v, anchor, pieces): variants that too many texts share, recognised on a sample; decides balance only."""
    sampled = classes.filter(F.pmod(F.xxhash64("c1", "c2"), F.lit(HOT_SAMPLE)) == 0).select("c1", F.explode("variants").alias("v"))
    counted = sampled.groupBy("v").agg(F.min("c1").alias("anchor"), (F.count(F.lit(1)) * HOT_SAMPLE).alias("rows"))
    hot = counted.filter(F.col("rows") > BUCKET_ROWS)
    return hot.select("v", "anchor", F.ceil(F.col("rows") / BUCKET_ROWS).cast("int").alias("pieces"))


def shared_variants(contents: DataFrame) -> tuple[DataFrame, bool]:
    """(v, n, first, anchor): rows of variants that several contents share, with the first of their bucket.

    Also whether any bucket was cut into pieces.
    """
    rows = contents.select(F.col("c1").alias("n"), F.explode("variants").alias("v"))
    hot = cut(hot_variants(contents))
    n_hot = hot.count()
    cut_up = n_hot > 0
    if cut_up:
        piece = F.coalesce(F.pmod(F.xxhash64("n"), F.col("pieces")), F.lit(0)).cast("int")
        rows = rows.join(F.broadcast(hot) if n_hot <= FEW_HOT else hot, "v", "left").select("v", "n", "anchor", piece.alias("piece"))
    else:
        rows = rows.select("v", "n", F.lit(None).cast("long").alias("anchor"), F.lit(0).alias("piece"))
    bucket = Window.partitionBy("v", "piece").orderBy("n")
    placed = rows.select("v", "n", "anchor", F.first("n").over(bucket).alias("first"), F.lag("n").over(bucket).alias("last"), F.lead("n").over(bucket).alias("next"))
    return cut(placed.filter("last IS NOT NULL OR next IS NOT NULL OR anchor IS NOT NULL").drop("last", "next")), cut_up


def _across(buckets: DataFrame, low: int, high: int, cut_up: bool) -> DataFrame:
    """(n, m): rows of (v, n, g) that are ``low`` to ``high`` apart in the order of their bucket and in different groups.

    Where buckets were cut into pieces, none is gathered: rows are numbered by blocked prefix sums, and each meets the rows of
    its own stretch of ``high`` numbers and of the stretch before.
    """
    if not cut_up:
        further = Window.partitionBy("v").orderBy("n").rowsBetween(-high, -low)
        others = buckets.select("n", "g", F.collect_list(F.struct(F.col("n").alias("m"), F.col("g").alias("h"))).over(further).alias("others"))
        return others.select("n", "g", F.explode("others").alias("o")).filter("g != o.h").select("n", "o.m")
    numbered = cut(prefix_sum(buckets.select("v", "n", "g"), ["v"], ["n"], F.lit(1), "at"))
    stretch = F.floor(F.col("at") / high)
    here = numbered.select("v", "n", "g", "at", stretch.alias("stretch"))
    back = numbered.select("v", F.col("n").alias("m"), F.col("g").alias("h"), F.col("at").alias("from"), F.explode(F.array(stretch, stretch + 1)).alias("stretch"))
    apart = F.col("at") - F.col("from")
    return here.join(back, ["v", "stretch"]).filter((apart >= low) & (apart <= high) & (F.col("g") != F.col("h"))).select("n", "m")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("m IS NOT NULL AND m != n").select(F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b")).distinct()


def least_agreement(s: Signature) -> int:
    """The fewest of 64 positions that agree in two bits, within ``deviations``, for a pair at the least similarity.

    A position agrees with probability J, else by chance in one of four.
    """
    if s.deviations is None:
        return 0
    p = s.similarity + (1 - s.similarity) / 4
    n = min(64, s.segments * s.width)
    return int(max(0, np.floor(n * p - s.deviations * np.sqrt(n * p * (1 - p)))))


class _Verifier:
    """Exact similarity of candidate pairs.

    Sizes and two bits of each signature position, which are narrow, sort out most chance pairs; full shingle
    sets are made for the contents of what remains.
    """

    def __init__(self, df: DataFrame, key: str, time: str | None, text: str, reps: DataFrame, s: Signature):
        t = F.col(f"`{time}`").cast("timestamp") if time else F.lit(None).cast("timestamp")
        self.texts = df.select(F.col(f"`{key}`").alias("k"), t.alias("t"), F.col(f"`{text}`").alias("text"))
        self.reps, self.s = reps, s

    def plausible(self, pairs: DataFrame) -> DataFrame:
        s, near = self.s, F.lit(self.s.similarity)
        a = self.reps.select(F.col("c1").alias("a"), F.col("size").alias("size_a"), F.col("low").alias("low_a"), F.col("high").alias("high_a"))
        b = self.reps.select(F.col("c1").alias("b"), F.col("size").alias("size_b"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
        differ = F.col("low_a").bitwiseXOR(F.col("low_b")).bitwiseOR(F.col("high_a").bitwiseXOR(F.col("high_b")))
        agree = F.lit(min(64, s.segments * s.width)) - F.bit_count(differ)
        # The intersection is at most the smaller set, the union at least the larger.
        sizes = F.least("size_a", "size_b") >= near * F.greatest("size_a", "size_b")
        return pairs.join(a, "a").join(b, "b").filter(sizes & (agree >= least_agreement(s))).select("a", "b").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs whose similarity reaches the least; materialised."""
        words, near = self.s.words, F.lit(self.s.similarity)

        def sets(batches):
            table = _Words()
            for batch in batches:
                found = [x for x in shingle_sets(batch["text"], words, table) if len(x)]
                yield pd.DataFrame({"c1": [content_hash(x, 0) for x in found], "set": [x.view(np.int64) for x in found]})

        pairs = cut(self.plausible(pairs))
        n = pairs.count()
        if not n:
            return pairs
        both = pairs.select(F.col("a").alias("c1")).unionByName(pairs.select(F.col("b").alias("c1"))).distinct()
        wanted = self.reps.join(both, "c1", "left_semi").select(F.col("k").alias("rk"), F.col("t").alias("rt"))
        if 2 * n <= FEW_KEYS:
            wanted = F.broadcast(wanted)
        used = self.texts.join(wanted, F.col("k").eqNullSafe(F.col("rk")) & F.col("t").eqNullSafe(F.col("rt"))).select("text")
        used = cut(used.mapInPandas(sets, "c1 long, set array<long>").groupBy("c1").agg(F.first("set").alias("set")))
        a, b = used.select(F.col("c1").alias("a"), F.col("set").alias("x")), used.select(F.col("c1").alias("b"), F.col("set").alias("y"))
        common = F.size(F.array_intersect("x", "y"))
        return cut(pairs.join(a, "a").join(b, "b").filter(common >= near * (F.size("x") + F.size("y") - common) - 1e-9).select("a", "b"))


def near_duplicates(df: DataFrame, key: str, text: str, time: str | None = None, signature: Signature = Signature()) -> DataFrame:
    """(key, group_id, group_size, links): one row per text, with the least key of its group.

    Two texts are linked if of the distinct sequences of ``words`` consecutive words in either at least the
    share ``similarity`` is in both; groups are closed over links.  ``links`` counts the contents that the text's
    content was compared with and linked to: pairs already known to be in one group are not compared.  Of a key
    delivered several times the last by ``time`` counts (of equals, one by content hash).  A text with fewer than
    ``words`` words, empty or null, is a group of its own; a null key is left out.  Texts with equal shingle sets
    are one content and compared once.  An empty table gives an empty result; other columns are ignored, whatever
    their names.

    Contents sharing a variant are first compared with the bucket's first, and grouped.  Where a bucket still holds
    several groups, all its pairs across groups are compared: at once if those of all such buckets are no more than
    the rows, else in rounds that each reach four times further along the bucket's order and leave out what has become
    one group.  So every pair of a bucket is known to be in one group or was compared, and a bucket of near copies costs as much as
    it has rows.  What is lost: pairs whose signatures share no variant, and pairs that the sketches rule out (``Signature``).
    """
    s = signature
    rows = cut(index(df, key, time, text, s))
    docs = cut(rows.groupBy("k").agg(F.max(F.struct("t", "c1", "c2", "size", "low", "high")).alias("r")).select("k", "r.*"))
    reps = docs.filter("size > 0").groupBy("c1", "c2").agg(F.min(F.struct("k", "t", "size", "low", "high")).alias("rep")).select("c1", "c2", "rep.*")
    contents = rows.filter("size > 0").groupBy("c1", "c2").agg(F.first("variants").alias("variants")).join(reps.select("c1", "c2"), ["c1", "c2"], "left_semi")
    shared, cut_up = shared_variants(contents)
    verify = _Verifier(df, key, time, text, reps, s)

    near = shared.select("n", F.explode(F.array_distinct(F.array("first", "anchor"))).alias("m"))
    links = verify.links(_ordered(near))
    roots = components(links, "a", "b")
    low, high, n_shared = 1, 4, shared.count()
    while True:
        grouped = shared.join(roots.withColumnRenamed("node", "n"), "n", "left").select("v", "n", F.coalesce("root", "n").alias("g"))
        still = grouped.groupBy("v").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count(F.lit(1)).alias("rows")).filter((F.col("lo") != F.col("hi")) & (F.col("rows") > (low if low > 1 or cut_up else 2)))
        open_pairs, longest = still.agg(F.sum(F.col("rows") * (F.col("rows") - 1) / 2), F.max("rows")).first()
        if longest is None:
            break
        if open_pairs <= n_shared:
            high = max(high, longest)
        buckets = grouped.join(still.select("v"), "v")
        more = verify.links(_ordered(_across(buckets, low, high, cut_up)))
        if not more.isEmpty():
            links = cut(links.unionByName(more).distinct())
            roots = components(links, "a", "b")
        low, high = high + 1, 4 * high

    ends = links.select(F.col("a").alias("c1")).unionByName(links.select(F.col("b").alias("c1"))).groupBy("c1").agg(F.count(F.lit(1)).alias("links"))
    known = docs.join(roots.withColumnRenamed("node", "c1"), "c1", "left").join(ends, "c1", "left")
    own = F.col("size") == 0
    placed = known.select("k", own.alias("own"), F.coalesce("root", "c1").alias("g"), F.coalesce("links", F.lit(0)).alias("links"))
    groups = placed.filter("NOT own").groupBy("g").agg(F.min("k").alias("group_id"), F.count(F.lit(1)).alias("group_size"))
    joined = placed.filter("NOT own").join(groups, "g").select("k", "group_id", "group_size", "links")
    alone = placed.filter("own").select("k", F.col("k").alias("group_id"), F.lit(1).cast("long").alias("group_size"), "links")
    return joined.unionByName(alone).withColumnRenamed("k", key)
