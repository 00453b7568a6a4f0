"""Near copies: SimHash near-dedup of five-word shingles with every link verified, completed exactly at similarity 0.8.

Sets of shingles get SimHash fingerprints, which ``simhash`` joins through their binary trie; its links, and those between
sets of one fingerprint, are verified by Jaccard similarity and make the first components. Fingerprints of similarity 0.8
differ in up to a quarter of their bits, which no trie walk can allow at scale, so an exact join finds what is left
between components: two sets of similarity 0.8 share one of their first ``n - ceil(0.8 n) + 1`` shingles, whatever order all
shingles are put in (prefix filter). The order here is by number in a bounded sample, then by hash, so passages that many
texts share come last and seldom are keys; the sample changes the work, never the links. Under a key of up to ``HOT``
sets all pairs of different components that size and place allow are verified, under a hotter one those with the least set.
Then hot keys that still hold several components are gone through once more: pairs of sets in different components that
also the numbers of their shingles by ``CELLS`` parts of the hashes allow are verified, so no link is lost.

Defined cases: words are as in ``simhash``; a text of fewer words is one shingle; a null text is an empty one, and texts
without words are all alike; rows that repeat share their component; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm import simhash
from tidewrack.llm.rows import slices
from tidewrack.llm.simhash import _LOWER
from tidewrack.operators.components import components
from tidewrack.session import cut, forget, lookup, release, stored, tables

WIDTH = 5
#: Sets of a key that are paired at once.
HOT = 64
#: Documents that the order of shingles is worked out from, times a shingle has to be among them, and shingles kept.
SAMPLE, OFTEN, ORDERED = 20_000, 4, 200_000
#: Parts of the hashes, a power of two.
CELLS = 128
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashed shingles in ascending order, as signed longs."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.int64)
    known = {w: xxhash.xxh64_intdigest(w, 7) for w in set(words)}
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    n, size = max(1, len(words) - width + 1), min(width, len(words))
    mixed = np.full(n, size, np.uint64)
    for i in range(size):
        mixed = (mixed ^ (h[i : i + n] * _FACTORS[i % len(_FACTORS)])) * _FACTORS[0]
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed.view(np.int64))


def cell_counts(grams: np.ndarray) -> bytes:
    """How many shingles lie in each of CELLS parts of the hashes; 255 for that many or more."""
    return np.minimum(np.bincount(grams & (CELLS - 1), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _order(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that recur in a sample, ascending, and their numbers."""
    step = max(1, docs.count() // SAMPLE)
    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(step)) == 0)

    def apply(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *[shingles(t, width) for t in batch.column("text").to_pylist()]]))], ["gram"])

    counted = sample.mapInArrow(apply, "gram long").groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN)
    found = counted.orderBy(F.desc("n"), "gram").limit(ORDERED).toArrow()
    grams, numbers = (found.column(c).to_numpy() for c in ("gram", "n"))
    by = np.argsort(grams)
    return grams[by], numbers[by]


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, digest, sid, n, fp, first, counts: every row's set of shingles by its own number and size, its fingerprint, its first
    shingles in the common order, and the numbers of its shingles by CELLS parts of their hashes, 255 for more."""
    shared = docs.sparkSession.sparkContext.broadcast(_order(docs, width))

    def apply(batches):
        known, numbers = shared.value
        for batch in slices(batches):
            sids, sizes, fps, firsts, counts = [], [], [], [np.zeros(0, np.int64)], []
            for text in batch.column("text").to_pylist():
                own = shingles(text, width)
                n = len(own)
                sids.append(xxhash.xxh64_intdigest(own.tobytes(), 1))
                sizes.append(n)
                fps.append(simhash.majority(own.view(np.uint64)))
                counts.append(cell_counts(own))
                if len(known) and n:
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[at] == own, numbers[at], 0), kind="stable")]
                firsts.append(own[: n - (4 * n + 4) // 5 + 1])
            ends = np.cumsum([len(f) for f in firsts]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (sids, fps)]
            columns = [batch.column("doc_id"), batch.column("digest"), signed[0], pa.array(sizes, pa.int64()), signed[1], lists, pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "sid", "n", "fp", "first", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return stored(rows.mapInArrow(apply, "doc_id long, digest long, sid long, n long, fp long, first array<long>, counts binary"))


def _grouped(batches, columns):
    """The rows of whole keys, as arrays; rows come sorted by their first column."""
    held = []
    for batch in batches:
        rows = [batch.column(c).to_numpy() for c in columns]
        if not len(rows[0]):
            continue
        at = int(np.searchsorted(rows[0], rows[0][-1]))
        if at or (held and held[-1][0][-1] != rows[0][0]):
            if not at:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            else:
                yield [np.concatenate(x) for x in zip(*held, [r[:at] for r in rows], strict=True)]
                held = []
        held.append([r[at:] for r in rows])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _possible(n, place, i, j):
    """Whether size and place leave similarity 0.8 possible to the pairs (i, j), if this is their first common shingle."""
    both = n[i] + n[j]
    return (9 * np.minimum(n[i] - place[i], n[j] - place[j]) >= 4 * both) & (5 * np.minimum(n[i], n[j]) >= 4 * np.maximum(n[i], n[j]))


def _most(counts: np.ndarray, n: np.ndarray, i, j) -> np.ndarray:
    """What the sets i and j share at most. A full cell says nothing about how many more there are."""
    few = np.minimum(counts[i], counts[j]).sum(axis=-1, dtype=np.int64)
    full = ((counts[i] == 255) & (counts[j] == 255)).any(axis=-1)
    return np.where(full, np.minimum(n[i], n[j]), few)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, CELLS)


def _named(sid, i, j) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[i], sid[j])), pa.array(np.maximum(sid[i], sid[j]))], ["a", "b"])


def _pairs(keyed: DataFrame, hot: int) -> tuple[DataFrame, DataFrame]:
    """a, b: pairs to verify between components; under hot keys those with the least set. And gram: the hot keys of several
    components. ``keyed`` has gram, sid, n, place, label; size and place travel as one number."""
    columns = ["gram", "sid", "np", "label"]

    def apply(batches):
        for chunk in _grouped(batches, columns):
            fresh = np.ones(len(chunk[0]), bool)  # rows that repeat in full may stand for one set
            fresh[1:] = (chunk[0][1:] != chunk[0][:-1]) | (chunk[1][1:] != chunk[1][:-1])
            gram, sid, both, label = (c[fresh].astype(np.int64) for c in chunk)
            n, place = both >> 32, both & 0xFFFFFFFF
            starts = np.concatenate(([0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]))
            left, right, hotter = [], [], []
            for g in np.flatnonzero(np.diff(starts) > 1).tolist():
                lo, hi = int(starts[g]), int(starts[g + 1])
                if hi - lo <= hot:
                    i, j = np.triu_indices(hi - lo, 1)
                else:
                    i, j = np.zeros(hi - lo - 1, np.int64), np.arange(1, hi - lo)
                    if (label[lo:hi] != label[lo]).any():
                        hotter.append(gram[lo])
                left.append(i + lo)
                right.append(j + lo)
            if left:
                i, j = np.concatenate(left), np.concatenate(right)
                ok = _possible(n, place, i, j) & (label[i] != label[j])
                yield _named(sid, i[ok], j[ok])
            if hotter:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(hotter)), pa.nulls(len(hotter), pa.int64())], ["a", "b"])

    packed = keyed.select("gram", "sid", (F.col("n") * (1 << 32) + F.col("place")).alias("np"), "label")
    placed = packed.repartition("gram").sortWithinPartitions("gram", "sid")
    found = cut(placed.mapInArrow(apply, "a long, b long").distinct())
    return found.filter("b IS NOT NULL"), found.filter("b IS NULL").select(F.col("a").alias("gram"))


def _pairs_of_hot(keyed: DataFrame) -> DataFrame:
    """a, b: pairs to verify under hot keys, between components. ``keyed`` has gram, sid, n, place, label, counts."""

    def across(rows):
        sid, n, place, label = (np.array(x, np.int64) for x in list(zip(*rows, strict=True))[1:5])
        counts = np.frombuffer(b"".join(r[5] for r in rows), np.uint8).reshape(-1, CELLS)
        names, sizes = np.unique(label, return_counts=True)
        open_ = np.ones(len(sid), bool)  # sets that still have to be held against the rest
        for i in np.flatnonzero(label != names[sizes.argmax()]).tolist():
            open_[i] = False
            j = np.flatnonzero(open_ & (label != label[i]))
            j = j[_possible(n, place, i, j)]
            j = j[9 * _most(counts, n, i, j) >= 4 * (n[i] + n[j])]
            if len(j):
                yield _named(sid, np.full(len(j), i), j)

    def apply(batches):
        held, last = [], None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                if row[0] != last and held:
                    yield from across(held)
                    held = []
                last = row[0]
                held.append(row)
        if held:
            yield from across(held)

    placed = keyed.select("gram", "sid", "n", "place", "label", "counts").repartition("gram").sortWithinPartitions("gram", "sid")
    return cut(placed.mapInArrow(apply, "a long, b long").distinct())


def _asked(pairs: DataFrame) -> DataFrame:
    return lookup(cut(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()))


def _verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs whose sets are alike. Parts of the hashes bound what two sets share, so few sets are made again from texts."""
    mark = tables()

    def bounded(batches):
        for batch in batches:
            n = np.concatenate([batch.column(c).to_numpy() for c in ("na", "nb")])
            counts = np.concatenate([_matrix(batch.column(c)) for c in ("ca", "cb")])
            i, j = np.arange(len(batch)), np.arange(len(batch)) + len(batch)
            yield batch.select(["a", "b"]).filter(pa.array(9 * _most(counts, n, i, j) >= 4 * (n[i] + n[j])))

    counts = cut(reps.select("sid", "n", "counts").join(_asked(pairs), "sid", "left_semi").dropDuplicates(["sid"]))
    pairs = cut(pairs.join(counts.toDF("a", "na", "ca"), "a").join(counts.toDF("b", "nb", "cb"), "b").mapInArrow(bounded, "a long, b long"))

    def made(batches):
        for batch in slices(batches):
            grams = [shingles(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(grams, pa.list_(pa.int64()))], ["sid", "grams"])

    one = reps.join(_asked(pairs), "sid", "left_semi").select("sid", F.col("digest").alias("r_digest"), F.col("doc_id").alias("r_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.xxhash64("text"))
    one = lookup(cut(one))
    release(docs.sparkSession)  # texts that an earlier step has moved may still lie in shuffle files
    rows = rows.join(one, (F.col("digest") == F.col("r_digest")) & F.col("doc_id").eqNullSafe(F.col("r_id")))
    known = stored(rows.select("sid", "text").mapInArrow(made, "sid long, grams array<long>").dropDuplicates(["sid"]))
    both = pairs.join(known.toDF("a", "ga"), "a").join(known.toDF("b", "gb"), "b")
    shared = F.size(F.array_intersect("ga", "gb"))
    alike = cut(both.filter(9 * shared >= 4 * (F.size("ga") + F.size("gb"))).select("a", "b"))
    forget(docs.sparkSession, mark, alike)
    return alike


def _labels(links: DataFrame, reps: DataFrame) -> DataFrame:
    """``reps`` with label, the component so far."""
    found = cut(components(links).select(F.col("node").alias("sid"), F.col("component").alias("label")))
    return reps.join(lookup(found), "sid", "left").withColumn("label", F.coalesce("label", "sid"))


def _by_fingerprint(reps: DataFrame, budget: int) -> DataFrame:
    """a, b: sets linked by the trie of their fingerprints, and sets of one fingerprint with the least of them."""
    heads = cut(reps.groupBy("fp").agg(F.min("sid").alias("head")))
    same = reps.join(heads, "fp").filter("sid <> head").select(F.col("head").alias("a"), F.col("sid").alias("b"))
    near = simhash.links(heads.select("fp"), budget).toDF("fa", "fb")
    near = near.join(heads.toDF("fa", "a"), "fa").join(heads.toDF("fb", "b"), "fb")
    return cut(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).union(same))


def distinct_sets(found: DataFrame) -> DataFrame:
    """The rows of ``found`` that stand for their sets, none for empty ones. Copies count once; only sets that have copies are
    looked at twice."""
    own = found.filter("n > 0")
    row = F.struct("digest", "doc_id")
    many = own.groupBy("sid").agg(F.count("*").alias("rows"), F.min(row).alias("r")).filter("rows > 1").select("sid", "r")
    return own.join(lookup(cut(many)), "sid", "left").filter(F.col("r").isNull() | row.eqNullSafe(F.col("r"))).drop("r")


def completed(out: DataFrame, reps: DataFrame, keys: Callable[[DataFrame], DataFrame], docs: DataFrame, width: int, hot: int) -> DataFrame:
    """a, b: the verified links ``out`` and those that join their components under ``keys`` (gram, sid, n, place, label of the rows of
    ``reps`` with label). Two sets with a common key are linked, if alike, by a path at least."""
    pairs, hotter = _pairs(keys(_labels(out, reps)), hot)
    out = cut(out.union(_verified(pairs, reps, docs, width)))
    if not hotter.isEmpty():
        left = keys(_labels(out, reps)).join(lookup(hotter), "gram").join(reps.select("sid", "counts").dropDuplicates(["sid"]), "sid")
        out = out.union(_verified(_pairs_of_hot(left), reps, docs, width))
    return out


def links(found: DataFrame, docs: DataFrame, width: int = WIDTH, hot: int = HOT, budget: int = simhash.BITS) -> DataFrame:
    """a, b: links that connect the sets ``found`` of ``docs`` exactly as all pairs of similarity 0.8 do."""
    reps = distinct_sets(found)
    prefixes = lambda rows: rows.select("sid", "n", "label", F.posexplode("first").alias("place", "gram"))
    return completed(_verified(_by_fingerprint(reps, budget), reps, docs, width), reps, prefixes, docs, width, hot)


def _labelled(docs: DataFrame, width: int, hot: int) -> DataFrame:
    """doc_id, digest, label: one row a document."""
    found = sets(docs, width)
    return _labels(links(found, docs, width, hot), found).select("doc_id", "digest", "label")


def near_copies(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """doc_id, digest, label, component_id: one row a document; component_id is the least doc_id of the component."""
    labelled = cut(_labelled(docs, width, hot))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "label").select("doc_id", "digest", "label", "component_id")


def keep_one(docs: DataFrame, width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest doc_id stays, a null one last."""
    mark = tables()
    labelled = cut(_labelled(docs, width, hot))
    forget(docs.sparkSession, mark, labelled)  # sets are several times as wide
    return simhash.one_of_each(docs, labelled)
