"""Exact top-k inner products: shards by the top of one ball tree, a ball tree in every shard, branch and bound in both.

Vectors become integers, ``floor(SCALE * x)``. Of equal vectors only the k + 1 rows with the smallest ids can be an answer, so a
very common vector is a few rows. The top of a ball tree, fitted on a bounded sample, deals all rows to at most
``SPACES`` spaces; centres are fixed by the sample, radii are those of all rows. A space of more than ``SHARD`` rows is
several shards. A query goes first to the ``NEAR`` spaces with the highest bounds ``q.c + |q| r``, then, with the kth score so
far, to the other spaces whose bound is not below it. In a shard a node's bound is never above its parent's; queries take
leaves in the order of bounds, all that stand at the same leaf together, and each stops when the next bound is below its kth score.

Where vectors have no structure (independent directions in many dimensions) no bound can prune, and every exact method
compares nearly all queries with all rows; see the README for the measured share.

Defined cases: rows whose vector is null, or has a null or non-finite component, take no part; a query is compared with
vectors of its own length only; fewer than k candidates give all of them; equal scores go to the smaller id (null last),
repeated rows are candidates of each other; components and scores beyond 64 bits are the nearest 64-bit number. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.session import cut, lookup

SCALE = 64
K = 20
EVERY = 20
SHARD = 8192
BLOCK = 50_000
LEAF = 256
#: Numbers in the sample that spaces are fitted on, rows of it a space, most spaces, vector lengths with spaces of their own.
SAMPLE, ROWS, SPACES, LENGTHS = 1 << 22, 16, 1024, 4
NEAR = 2
_NONE = np.iinfo(np.int64).min
FOUND = "q_row long, query_id long, row_id long, vec_id long, score long"
NAMES = ["q_row", "query_id", "row_id", "vec_id", "score"]


def _halves(own: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction, and the middle of ``own`` along it: from a far point to the one farthest from that."""
    a = own[((own - centre) ** 2).sum(axis=1).argmax()]
    along = own[((own - a) ** 2).sum(axis=1).argmax()] - a
    return along, float(np.median(own @ along))


class Spaces:
    """The top of a ball tree. Nodes as arrays: children of node i are ``left[i]`` and ``left[i] + 1``, a leaf has 0."""

    def __init__(self, sample: np.ndarray, leaves: int):
        width = sample.shape[1]
        parts, self.left, self.along, self.middle, self.centre = [sample], [0], [np.zeros(width)], [0.0], []
        least = max(ROWS, len(sample) // max(1, leaves))
        i = 0
        while i < len(parts):
            own = parts[i]
            self.centre.append(own.mean(axis=0) if len(own) else np.zeros(width))
            if len(own) >= 2 * least and len(parts) < 2 * SPACES - 1:
                along, middle = _halves(own, self.centre[i])
                low = own @ along <= middle
                if low.any() and not low.all():
                    self.left[i], self.along[i], self.middle[i] = len(parts), along, middle
                    parts += [own[low], own[~low]]
                    self.left += [0, 0]
                    self.along += [np.zeros(width)] * 2
                    self.middle += [0.0, 0.0]
            parts[i] = None
            i += 1
        self.left, self.along, self.middle, self.centre = (np.array(a) for a in (self.left, self.along, self.middle, self.centre))
        self.leaves = np.flatnonzero(self.left == 0)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The node of the leaf of each row, and the row's distance from its centre."""
        at = np.zeros(len(x), np.int64)
        while (inner := np.flatnonzero(self.left[at])).size:
            node = at[inner]
            at[inner] = self.left[node] + ((x[inner] * self.along[node]).sum(axis=1) > self.middle[node])
        return at, np.sqrt(((x - self.centre[at]) ** 2).sum(axis=1))


class Tree:
    """Nodes as arrays; children of node i are ``left[i]`` and ``left[i] + 1``, a leaf has ``left[i] == 0``."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        points = x.astype(np.float64)
        lo, hi, left, above, centre, radius = [0], [len(x)], [0], [0], [], []
        i = 0
        while i < len(lo):
            own = points[self.order[lo[i] : hi[i]]]
            c = own.mean(axis=0)
            far = math.sqrt(((own - c) ** 2).sum(axis=1).max())
            centre.append(c)
            radius.append(far)
            if len(own) > leaf and far > 0:
                along = np.argsort(own @ _halves(own, c)[0], kind="stable")
                self.order[lo[i] : hi[i]] = self.order[lo[i] : hi[i]][along]
                mid = lo[i] + len(own) // 2
                left[i] = len(lo)
                lo += [lo[i], mid]
                hi += [mid, hi[i]]
                left += [0, 0]
                above += [i, i]
            i += 1
        self.lo, self.hi, self.left, self.above = lo, hi, np.array(left), above
        self.centre, self.radius = np.array(centre), np.array(radius)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of products (queries, nodes): none above that of the node's parent."""
        upper = _upper(q, self.centre, self.radius)
        for node in range(1, len(self.above)):
            np.minimum(upper[:, node], upper[:, self.above[node]], out=upper[:, node])
        return upper


def _upper(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    norms = np.sqrt((q**2).sum(axis=1))[:, None]
    size = norms * np.sqrt((centre**2).sum(axis=1) + radius**2)[None, :]
    return q @ centre.T + norms * radius[None, :] + size * 1e-9 + 1e-6 * (1 + norms)


def search(tree: Tree, x: np.ndarray, queries: np.ndarray, bound: np.ndarray, skip: np.ndarray, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, place in ``x``, score) of each query's best, ties to the smaller ``key``; only scores of ``bound`` and more.

    ``skip`` is the place of the query's own row or -1. Products are exact: the caller sees to it that they fit.
    """
    q, places = queries.astype(np.float64), tree.order
    own, shift = x[places].astype(np.float64), max(1, int(len(x)).bit_length())
    rank = (1 << shift) - 1 - key[places]  # score and rank in one number: the higher the better
    by_rank = np.empty(1 << shift, np.int64)
    by_rank[rank] = places
    leaves = np.flatnonzero(tree.left == 0)
    upper = tree.bounds(q)[:, leaves]
    order = np.argsort(-upper, axis=1, kind="stable")
    least, best = bound.astype(np.float64), np.full((len(q), k), _NONE)
    active = np.arange(len(q))
    for turn in range(len(leaves)):
        at = order[active, turn]
        open_ = upper[active, at] >= least[active]
        active, at = active[open_], at[open_]
        if not len(active):
            break
        grouped = np.argsort(at, kind="stable")
        for group in np.split(grouped, np.flatnonzero(np.diff(at[grouped])) + 1):
            node, who = leaves[at[group[0]]], active[group]
            lo, hi = tree.lo[node], tree.hi[node]
            s = q[who] @ own[lo:hi].T
            fit = (s >= least[who, None]) & (places[None, lo:hi] != skip[who, None])
            hit = np.flatnonzero(fit.any(axis=1))
            if not len(hit):
                continue
            joint = np.where(fit[hit], (s[hit].astype(np.int64) << shift) + rank[None, lo:hi], _NONE)
            joint = np.concatenate((best[who[hit]], joint), axis=1)
            joint.partition(joint.shape[1] - k, axis=1)
            best[who[hit]] = joint[:, -k:]
            low = joint[:, -k:].min(axis=1)
            least[who[hit]] = np.maximum(least[who[hit]], np.where(low == _NONE, -np.inf, low >> shift))
    which, column = np.nonzero(best != _NONE)
    found = best[which, column]
    return which, by_rank[found & ((1 << shift) - 1)], found >> shift


def search_wide(x: np.ndarray, queries: np.ndarray, bound: np.ndarray, skip: np.ndarray, k: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``search`` for numbers whose products need not fit: Python integers, every row, scores kept within 64 bits."""
    wide, out = x.astype(object), []
    for i, asked in enumerate(queries.astype(object)):
        scores = np.clip(wide @ asked, -(1 << 63) + 1, (1 << 63) - 1)
        fit = [p for p in range(len(x)) if p != skip[i] and scores[p] >= bound[i]]
        out += [(i, p, int(scores[p])) for p in sorted(fit, key=lambda p: (-scores[p], key[p]))[:k]]
    return tuple(np.array(c, np.int64) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def _matrix(t: pa.Table) -> np.ndarray:
    column = t.column("v").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)


def _key(t: pa.Table) -> np.ndarray:
    """Places of the rows in the order of (vec_id, row_id), null ids last."""
    ids = t.column("vec_id").is_null().to_numpy(zero_copy_only=False)
    plain = t.column("vec_id").fill_null(0).to_numpy()
    key = np.empty(len(t), np.int64)
    key[np.lexsort((t.column("row_id").to_numpy(), plain, ids))] = np.arange(len(t))
    return key


def _answer(shard: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    if not len(shard) or not len(asked):
        return pa.Table.from_arrays([pa.array([], pa.int64())] * 5, NAMES)
    x, q = _matrix(shard), _matrix(asked)
    rows, q_rows = shard.column("row_id").to_numpy(), asked.column("row_id").to_numpy()
    by_row = np.argsort(rows)
    at = by_row[np.minimum(np.searchsorted(rows, q_rows, sorter=by_row), len(rows) - 1)]
    skip = np.where(rows[at] == q_rows, at, -1)
    bound = np.array([-math.inf if b is None else b for b in asked.column("bound").to_pylist()])
    most = max(abs(int(f(a))) for a in (x, q) for f in (np.min, np.max))
    if most * most * x.shape[1] < 1 << 62 - max(10, len(x).bit_length()):
        which, place, score = search(Tree(x), x, q, bound, skip, k, _key(shard))
    else:
        which, place, score = search_wide(x, q, bound, skip, k, _key(shard))
    columns = [asked.column("row_id").take(which), asked.column("vec_id").take(which), shard.column("row_id").take(place), shard.column("vec_id").take(place), pa.chunked_array([pa.array(score, pa.int64())])]
    return pa.Table.from_arrays(columns, NAMES)


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v (array of long): the rows that take part."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf"))))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))
    return embeddings.filter(x.isNotNull() & (F.size(x) > 0) & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def _fitted(rows: DataFrame, n: int, longest: int, shard: int) -> dict[int, Spaces]:
    """Spaces by length of vector, for the ``LENGTHS`` commonest lengths of a sample of at most SAMPLE numbers."""
    most = max(ROWS, SAMPLE // max(1, longest))
    step = max(1, 2 * n // most)
    sample = rows.filter(F.pmod(F.xxhash64("row_id"), F.lit(step)) == 0).select("dim", "v").limit(most).toArrow()
    dims, counts = np.unique(sample.column("dim").to_numpy(), return_counts=True)
    out = {}
    for dim in dims[np.lexsort((dims, -counts))][:LENGTHS].tolist():
        own = _matrix(sample.filter(pc.equal(sample.column("dim"), dim))).astype(np.float64)
        out[dim] = Spaces(own, min(SPACES, math.ceil(n / shard)))
    return out


def top_k(vectors: DataFrame, is_query: F.Column, k: int = K, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, v) where ``is_query`` holds, against all other rows."""
    spark = vectors.sparkSession
    rows = cut(vectors.select("vec_id", "v", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row_id")))
    n, asking, longest = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max("dim"), F.lit(1))).first()
    blocks = max(1, math.ceil(asking / block))
    spaces = spark.sparkContext.broadcast(_fitted(rows, n, longest, shard))

    def placed(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            space, far = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            for dim in set(np.unique(dims).tolist()) & spaces.value.keys():
                own = np.flatnonzero(dims == dim)
                space[own], far[own] = spaces.value[dim].place(_matrix(pa.Table.from_batches([batch]).take(own)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(space), pa.array(far)], [*batch.schema.names, "space", "far"])

    same = Window.partitionBy("v").orderBy(F.col("vec_id").asc_nulls_last(), "row_id")
    once = rows.drop("asks").withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1).drop("nth")
    dealt = cut(once.mapInArrow(placed, "vec_id long, v array<long>, dim int, row_id long, space long, far double"))
    sizes = cut(dealt.groupBy("dim", "space").agg(F.ceil(F.count("*") / shard).cast("long").alias("parts"), F.max("far").alias("radius")))
    # At most LENGTHS x SPACES rows.
    known = sizes.filter(F.col("dim").isin(list(spaces.value))).collect()
    near: dict[int, tuple] = {}
    for dim in spaces.value:
        own = [(r.space, r.radius * (1 + 1e-9)) for r in known if r.dim == dim]
        near[dim] = tuple(np.array(c) for c in zip(*own, strict=True))
    shards = spark.sparkContext.broadcast(near)

    def routed(first: bool):
        def apply(batches):
            for batch in batches:
                dims, bound = batch.column("dim").to_numpy(), np.array([-math.inf if b is None else b for b in batch.column("bound").to_pylist()])
                who, where = [np.flatnonzero(~np.isin(dims, list(shards.value)))] if first else [], []
                where += [np.zeros(len(w), np.int64) for w in who]
                for dim in set(np.unique(dims).tolist()) & shards.value.keys():
                    own = np.flatnonzero(dims == dim)
                    number, radius = shards.value[dim]
                    upper = _upper(_matrix(pa.Table.from_batches([batch]).take(own)).astype(np.float64), spaces.value[dim].centre[number], radius)
                    turn = np.empty(upper.shape, np.int64)
                    np.put_along_axis(turn, np.argsort(-upper, axis=1, kind="stable"), np.arange(upper.shape[1])[None, :], axis=1)
                    i, j = np.nonzero(turn < NEAR if first else (turn >= NEAR) & (upper >= bound[own, None]))
                    who.append(own[i])
                    where.append(number[j])
                who, where = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (who, where))
                for at in range(0, len(who), 4096):
                    rows = batch.take(pa.array(who[at : at + 4096]))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(where[at : at + 4096])], [*rows.schema.names, "space"])

        return apply

    def answered(asked: DataFrame, first: bool) -> DataFrame:
        sent = asked.mapInArrow(routed(first), "row_id long, vec_id long, v array<long>, dim int, bound long, space long")
        sent = sent.join(lookup(sizes.select("dim", "space", "parts")), ["dim", "space"])
        sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("block", F.pmod(F.xxhash64("row_id"), F.lit(blocks)))
        own = dealt.join(lookup(sizes.select("dim", "space", "parts")), ["dim", "space"]).withColumn("part", F.pmod(F.xxhash64("row_id"), F.col("parts")))
        own = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        keys = ["dim", "space", "part", "block"]
        candidates, queries = own.select(*keys, "row_id", "vec_id", "v"), sent.select(*[F.col(c).alias(c) for c in (*keys, "row_id", "vec_id", "v", "bound")])
        return candidates.groupBy(*keys).cogroup(queries.groupBy(*[queries[c] for c in keys])).applyInArrow(lambda a, b: _answer(a, b, k), FOUND)

    asks = rows.filter("asks").select("row_id", "vec_id", "v", "dim")
    found = cut(answered(asks.withColumn("bound", F.lit(None).cast("long")), True))
    best = Window.partitionBy("q_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row_id")
    kth = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") == k).select(F.col("q_row").alias("row_id"), F.col("score").alias("bound"))
    more = answered(asks.join(kth, "row_id", "left").select("row_id", "vec_id", "v", "dim", "bound"), False)
    ranked = found.union(more).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_ball_tree(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % EVERY == 0)


OP10_SQL = """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, q.row_id AS q_row, c.vec_id, c.row_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.row_id <> c.row_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, (row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id, row_id))::INTEGER AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
