"""Exact top-k inner-product search by dual cover trees.

Vectors become integers floor(scale * x). Each goes to the nearest of a set of
pivots, taken from a bounded sample, and the vectors of a pivot are split by hash
into blocks of a fixed size, each of which becomes a cover tree; queries are dealt
by the same pivots into smaller blocks with trees of their own. A query block first
meets one candidate block of its own pivot, which gives each query a k-th score that
its final one cannot fall below. Blocks then meet only where
    <q, p> + r_q * |p| + r_p * |q| + r_q * r_p
(centres q and p, covering radii r of the roots) reaches the least of those scores,
so other candidate blocks are never shipped to that query block. Inside a pair of
blocks nodes are visited best bound first and dropped by the same rule. A task takes
one query block and a portion of its candidate blocks as a stream, best bound first,
and holds one tree of each; portions' lists are merged at the end. The sample and
the pivots decide only which block a vector is in, never the result.

Equal vectors of a block share one leaf entry with the rows of their k + 1 least
distinct ids, each id at most k times, which is all that a list of k without the
query's own id can use; so a vector that makes up a third of the rows costs no
more than any other. Ties go to smaller
ids. Null vectors, and those with null or non-finite components, take no part,
nor do null ids. Vectors of another length than the query's are no candidates.
Candidates that repeat the query's id count as the query itself; each query row
has a list of its own. Scores are exact while |q| |p| < 2^53; a block with
larger vectors raises an error.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, least_hashed, table

LEAF, MOST_CHILDREN = 96, 16
#: Rows of a candidate block and of a query block, and candidate blocks to a portion.
BLOCK, QUERIES, PORTION = 8192, 2048, 8
#: Most pivots and most rows of the sample that they come from, and its most components.
PIVOTS, SAMPLE, COMPONENTS = 512, 8192, 1 << 22
#: Candidate blocks whose bounds a row carries, and sizes of pivots that may be broadcast.
PACK, MOST_NAMES = 256, 50_000


class CoverTree:
    """Nodes over rows that lie in one range each; arrays instead of objects."""

    def __init__(self, points: np.ndarray):
        self.center, self.radius, self.low, self.high, self.children = [], [], [], [], []
        order = []
        self._add(points, np.arange(len(points)), order)
        self.order = np.array(order, np.int64)
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.length = np.sqrt((self.center**2).sum(axis=1))

    def _add(self, points, rows, order) -> int:
        node = len(self.low)
        own = points[rows]
        center = own.mean(axis=0)
        apart = np.sqrt(((own - center) ** 2).sum(axis=1))
        self.center.append(center)
        self.radius.append(float(apart.max()) * (1 + 1e-9) + 1e-9)
        self.low.append(len(order))
        self.high.append(0)
        self.children.append([])
        if len(rows) <= LEAF:
            order += rows.tolist()
        else:
            for part in self._cover(own, apart, self.radius[node] / 2):
                self.children[node].append(self._add(points, rows[part], order))
        self.high[node] = len(order)
        return node

    def _cover(self, own, apart, reach) -> list[np.ndarray]:
        """Row sets around centres more than ``reach`` apart, each row with its nearest centre.

        Where more than MOST_CHILDREN centres would be needed, the covering radius grows instead.
        """
        pick = int(apart.argmax())
        near, owner = np.full(len(own), np.inf), np.zeros(len(own), np.int64)
        for k in range(MOST_CHILDREN):
            away = np.sqrt(((own - own[pick]) ** 2).sum(axis=1))
            closer = away < near
            near[closer], owner[closer] = away[closer], k
            pick = int(near.argmax())
            if near[pick] <= reach:
                break
        parts = [np.flatnonzero(owner == k) for k in range(owner.max() + 1)]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) == len(own):  # rows too alike to part by distance
            return np.array_split(np.arange(len(own)), -(-len(own) // LEAF))
        return parts


class Block:
    """A cover tree over distinct integer vectors, with the ids that each stands for.

    With ``keep`` only the rows of its ``keep`` least distinct ids, each id at most keep - 1 times.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int | None):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        _, first, same = np.unique(vectors.view(f"V{vectors.itemsize * vectors.shape[1]}") if vectors.shape[1] else np.zeros(len(ids)), return_index=True, return_inverse=True)
        same = same.ravel()
        distinct = vectors[first].astype(np.float64)
        if len(distinct) and (distinct**2).sum(axis=1).max() >= 2.0**53:
            raise ValueError("a vector's squared length is 2^53 or more: scores would not be exact")
        self.tree = CoverTree(distinct)
        place = np.empty(len(distinct), np.int64)
        place[self.tree.order] = np.arange(len(distinct))
        at = place[same]
        by = np.argsort(at, kind="stable")  # ids ascend within each vector
        starts = np.searchsorted(at[by], np.arange(len(distinct)))
        if keep is not None:
            of, own = at[by], ids[by]
            fresh = np.append(True, (of[1:] != of[:-1]) | (own[1:] != own[:-1]))[: len(by)]  # the first row of an id
            nth = np.cumsum(fresh) - 1
            copy = np.arange(len(by)) - np.flatnonzero(fresh)[nth]
            by = by[(nth - nth[starts[of]] < keep) & (copy < keep - 1)]
            starts = np.searchsorted(at[by], np.arange(len(distinct)))
        self.points, self.ids, self.starts = distinct[self.tree.order], ids[by], np.append(starts, len(by))


class Best:
    """The k best candidates of each query so far; ``floor`` holds scores that each query has k of elsewhere."""

    def __init__(self, queries: Block, k: int, floor: np.ndarray | None = None):
        self.queries, self.k = queries, k
        rows = len(queries.ids)
        self.floor = np.full(rows, -np.inf) if floor is None else floor
        self.score, self.id = np.full((rows, k), -np.inf), np.full((rows, k), 2**63 - 1, np.int64)
        self.row_of = np.repeat(np.arange(len(queries.points)), np.diff(queries.starts))

    def worst(self, node: int) -> float:
        s = self.queries.starts
        rows = slice(s[self.queries.tree.low[node]], s[self.queries.tree.high[node]])
        return float(self.least(rows).min())

    def least(self, rows) -> np.ndarray:
        """What a score must reach to be of use to each query."""
        return np.maximum(self.score[rows, -1], self.floor[rows])

    def lists(self) -> pd.DataFrame:
        rows, cols = np.nonzero(~np.isneginf(self.score))
        return pd.DataFrame({"query_id": self.queries.ids[rows], "place": rows, "vec_id": self.id[rows, cols], "score": self.score[rows, cols].astype(np.int64)})

    def offer(self, qnode: int, data: Block, dnode: int) -> None:
        q, d = self.queries, data
        qlow, qhigh, dlow, dhigh = q.tree.low[qnode], q.tree.high[qnode], d.tree.low[dnode], d.tree.high[dnode]
        scores = q.points[qlow:qhigh] @ d.points[dlow:dhigh].T
        rows = np.arange(q.starts[qlow], q.starts[qhigh])
        scores = scores[self.row_of[rows] - qlow]
        hopeful = scores.max(axis=1) >= self.least(rows)
        if not hopeful.any():
            return
        rows, scores = rows[hopeful], scores[hopeful]
        copies = np.diff(d.starts[dlow : dhigh + 1])
        scores = np.repeat(scores, copies, axis=1)
        ids = d.ids[d.starts[dlow] : d.starts[dhigh]]
        ids = np.broadcast_to(ids, scores.shape)
        scores = np.where(ids == q.ids[rows][:, None], -np.inf, scores)
        ids = np.where(np.isneginf(scores), 2**63 - 1, ids)
        scores, ids = np.concatenate([self.score[rows], scores], axis=1), np.concatenate([self.id[rows], ids], axis=1)
        order = np.lexsort((ids, -scores), axis=1)[:, : self.k]
        self.score[rows], self.id[rows] = np.take_along_axis(scores, order, axis=1), np.take_along_axis(ids, order, axis=1)

    def search(self, data: Block) -> None:
        """Visit the pairs of nodes, best bound first, and drop those under the worst k-th score."""
        q, d = self.queries.tree, data.tree
        stack = [(self._bounds(0, data, [0])[0], 0, 0)]
        while stack:
            bound, a, b = stack.pop()
            if bound < self.worst(a):
                continue
            if not q.children[a] and not d.children[b]:
                self.offer(a, data, b)
            elif d.children[b] and (not q.children[a] or d.radius[b] >= q.radius[a]):
                found = self._bounds(a, data, d.children[b])
                stack += [(found[i], a, d.children[b][i]) for i in np.argsort(found)]
            else:
                found = [(self._bounds(c, data, [b])[0], c, b) for c in q.children[a]]
                stack += sorted(found)

    def _bounds(self, a: int, data: Block, nodes: list[int]) -> np.ndarray:
        q, d = self.queries.tree, data.tree
        exact = d.center[nodes] @ q.center[a]
        bound = exact + q.radius[a] * d.length[nodes] + d.radius[nodes] * q.length[a] + q.radius[a] * d.radius[nodes]
        return bound + 1e-9 * np.abs(bound) + 1e-6


def integer_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """vec_id, dim, v: valid vectors as integers."""
    real = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(real)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    return valid.select(F.col("vec_id").cast("long"), F.size("embedding").alias("dim"), whole.alias("v"))


def pivots(vectors: DataFrame, size: int) -> dict[int, np.ndarray]:
    """Centres for each length of vectors in a bounded sample: about one for ``size`` rows, spread first, then moved to means."""
    count, dim = vectors.agg(F.count("*"), F.max("dim")).first()
    most = min(SAMPLE, max(64, COMPONENTS // max(dim or 1, 1)))
    wanted = min(PIVOTS, -(-count // size), most // 8)
    if wanted <= 1:
        return {}
    sample, found = least_hashed(vectors, "vec_id", most).toPandas(), {}
    for dim, rows in sample.groupby("dim"):
        points = np.stack(rows["v"].to_numpy()).astype(np.float64)
        picked, near = [0], np.full(len(points), np.inf)
        while len(picked) < max(1, round(wanted * len(points) / len(sample))):
            near = np.minimum(near, ((points - points[picked[-1]]) ** 2).sum(axis=1))
            picked.append(int(near.argmax()))
        centres = points[picked]
        for _ in range(4):
            owner = nearest(points, centres)
            held = np.bincount(owner, minlength=len(centres)) > 0
            centres = np.stack([points[owner == k].mean(axis=0) for k in np.flatnonzero(held)])
        found[int(dim)] = centres
    return found


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * (points @ centres.T)).argmin(axis=1)


def blocks(vectors: DataFrame, centres: dict[int, np.ndarray], size: int, keep: int | None) -> DataFrame:
    """dim, pivot, part, parts, n, centre, length, radius, tree: blocks of about ``size`` rows around pivots, one pickled tree each."""

    def place(batches):
        for batch in batches:
            pivot = np.zeros(len(batch), np.int64)
            for dim in set(batch["dim"]) & set(centres):
                at = (batch["dim"] == dim).to_numpy()
                pivot[at] = nearest(np.stack(batch["v"][at].to_numpy()).astype(np.float64), centres[dim])
            yield batch.assign(pivot=pivot)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        block = Block(rows["vec_id"].to_numpy(), np.stack(rows["v"].to_numpy()).astype(np.int64), keep)
        tree, first = block.tree, rows[["dim", "pivot", "part", "parts"]].iloc[:1].reset_index(drop=True)
        return first.assign(n=len(rows), centre=[tree.center[0]], length=tree.length[0], radius=tree.radius[0], tree=[pickle.dumps(block)])

    placed = checkpoint(vectors.mapInPandas(place, "vec_id long, dim int, v array<bigint>, pivot long"))
    sizes = checkpoint(placed.groupBy("dim", "pivot").agg(F.ceil(F.count("*") / size).alias("parts")))
    spread = F.broadcast if sizes.count() <= MOST_NAMES else lambda df: df
    # rows, not ids, are dealt: copies of one id spread too
    part = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("parts"))
    dealt = placed.join(spread(sizes), ["dim", "pivot"]).withColumn("part", part)
    schema = "dim int, pivot long, part long, parts long, n long, centre array<double>, length double, radius double, tree binary"
    return dealt.groupBy("dim", "pivot", "part").applyInPandas(build, schema)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k best rows of ``vectors`` by inner product.

    Both are (vec_id, dim, v) as from ``integer_vectors``.
    """
    centres = pivots(vectors, BLOCK)
    block = F.struct("pivot", "part")
    data = checkpoint(blocks(vectors, centres, BLOCK, k + 1).withColumn("block", block))
    asked = blocks(queries, centres, QUERIES, None).withColumn("qblock", block).drop("part", "parts", "n")
    seeded = checkpoint(_seeded(asked, data, k))
    pairs = checkpoint(_pairs(seeded, data))
    keys = ["dim", "qblock", "portion"]
    first = seeded.join(pairs.select(*keys).distinct(), ["dim", "qblock"]).select(*keys, F.lit(0).alias("at"), "tree", "floor")
    meet = data.select("dim", "block", "tree").join(pairs, ["dim", "block"]).select(*keys, "at", "tree", F.lit(None).cast("array<double>").alias("floor"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    streams = first.union(meet).repartition(n, *keys).sortWithinPartitions(*keys, "at")
    streams = streams.select("dim", F.col("qblock.pivot").alias("pivot"), F.col("qblock.part").alias("part"), "at", "tree", "floor")

    def run(batches):
        best, block = None, {}
        for batch in batches:
            for dim, pivot, part, at, tree, floor in batch.itertuples(index=False):
                if at == 0:
                    if best is not None:
                        yield best.lists().assign(**block)
                    best, block = Best(pickle.loads(tree), k, np.array(floor, np.float64)), {"dim": dim, "pivot": pivot, "part": part}
                else:
                    best.search(pickle.loads(tree))
        if best is not None:
            yield best.lists().assign(**block)

    found = streams.mapInPandas(run, "query_id long, place long, vec_id long, score long, dim int, pivot long, part long")
    own = seeded.select(F.inline("lists"), "dim", "qblock.pivot", "qblock.part")
    order = Window.partitionBy("dim", "pivot", "part", "place").orderBy(F.desc("score"), "vec_id")
    return found.unionByName(own).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _seeded(asked: DataFrame, data: DataFrame, k: int) -> DataFrame:
    """Query blocks with their lists against one candidate block of their pivot, ``seed``, and the k-th scores there.

    ``floor`` has them by row and ``worst`` their least; -infinity without a seed or with fewer than k candidates.
    """
    parts = data.select("dim", "pivot", "parts").distinct()
    part = F.pmod(F.xxhash64("qblock"), F.col("parts"))
    chosen = asked.join(parts, ["dim", "pivot"], "left").withColumn("seed", F.when(F.col("parts").isNotNull(), F.struct("pivot", part.alias("part"))))
    met = chosen.join(data.select("dim", F.col("block").alias("seed"), F.col("tree").alias("other")), ["dim", "seed"], "left")
    lists = "array<struct<query_id: bigint, place: bigint, vec_id: bigint, score: bigint>>"

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                best = Best(pickle.loads(batch["tree"].iloc[i]), k)
                if batch["other"].iloc[i] is not None:
                    best.search(pickle.loads(batch["other"].iloc[i]))
                floor = best.score[:, -1]
                yield batch.iloc[i : i + 1].drop(columns="other").assign(floor=[floor], worst=float(floor.min()), lists=[best.lists().to_dict("records")])

    flat = met.select("dim", F.col("qblock.pivot").alias("p"), F.col("qblock.part").alias("t"), F.col("seed.part").alias("s"), "centre", "length", "radius", "tree", "other")
    schema = f"dim int, p long, t long, s long, centre array<double>, length double, radius double, tree binary, floor array<double>, worst double, lists {lists}"
    out = flat.mapInPandas(run, schema)
    qblock, seed = F.struct(F.col("p").alias("pivot"), F.col("t").alias("part")), F.struct(F.col("p").alias("pivot"), F.col("s").alias("part"))
    return out.withColumn("qblock", qblock).withColumn("seed", F.when(F.col("s").isNotNull(), seed)).drop("p", "t", "s")


def _pairs(seeded: DataFrame, data: DataFrame) -> DataFrame:
    """dim, qblock, block, portion, at: pairs whose bound reaches the query block's worst score, numbered best bound first.

    Candidate blocks travel as packs of about PACK centres and radii; each query block asks every pack.
    """
    packs = max(1, -(-data.count() // PACK))
    held = data.withColumn("pack", F.pmod(F.xxhash64("block"), F.lit(packs)).cast("int")).groupBy("dim", "pack").agg(F.collect_list(F.struct("block", "centre", "length", "radius")).alias("items"))
    asks = seeded.select("dim", "qblock", "seed", "worst", "centre", "length", "radius", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"))

    def bounded(b):
        exact = F.aggregate(F.zip_with("centre", b["centre"], lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
        bound = exact + F.col("radius") * b["length"] + b["radius"] * F.col("length") + F.col("radius") * b["radius"]
        return F.struct(b["block"].alias("block"), (bound + F.abs(bound) * 1e-9 + 1e-6).alias("bound"))

    judged = F.filter(F.transform("items", bounded), lambda b: (b["bound"] >= F.col("worst")) & ~b["block"].eqNullSafe(F.col("seed")))
    pairs = asks.join(held, ["dim", "pack"]).select("dim", "qblock", F.inline(judged))
    at = F.row_number().over(Window.partitionBy("dim", "qblock").orderBy(F.desc("bound"), "block"))
    return pairs.select("dim", "qblock", "block", at.alias("at")).withColumn("portion", F.floor((F.col("at") - 1) / PORTION))


def op3_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = checkpoint(integer_vectors(table(spark, sf_dir, "embeddings"), 64))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
s AS (
  SELECT query_id, vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(qe, e)]) AS BIGINT) AS score
  FROM q JOIN v ON vec_id <> query_id AND len(qe) = len(e)
), r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
