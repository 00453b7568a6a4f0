"""Document fingerprints by randomised edit embedding and bit sampling.

A shared random walk reads a text: at every step it emits the character it stands on, and a shared random bit, drawn for
(step, character), says whether it moves on. Texts a few edits apart fall into step again soon after each edit, so edit
distance becomes Hamming distance between walks. The fingerprint samples ``SAMPLES`` steps of the walk; sample k of a
text of n code points is one of its first 2n steps, chosen consistently: the choices for close lengths mostly coincide.
What is sampled is a byte of the hashed three characters from the walk's place on. All walks of a batch advance together
in numpy. Likeness is the share of equal samples.

Near-duplicates: bands of ``BAND`` consecutive samples are the keys of candidates, and the Jaccard similarity of five-word
shingles verifies them; of the sets under one key no pair that isn't connected already goes unverified.

Defined cases: a null text is an empty one, whose samples are all zero; equal texts have equal fingerprints; null ids come
after all others; rows that share an id follow each other in order of their text's digest; a table of one row is its own next
document; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm import nearcopies
from tidewrack.operators.components import components
from tidewrack.session import cut, lookup, release, stored

SAMPLES = 64
BAND = 4
PERIOD = 4096
#: Characters whose walks advance together, and documents of an Arrow batch that are held at once.
BLOCK = 4_000_000
#: Rows of a range of ids, and most ranges; what null ids count as.
RANGE, MOST_RANGES, LAST = 50_000, 10_000, 1e19


class Walk:
    """The shared randomness: bits by step and character, and for every sample its record steps."""

    def __init__(self, samples: int = SAMPLES, seed: int = 7):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bits = rng.integers(0, 2, (PERIOD, 256), np.uint8)
        self.records = []
        for _ in range(samples):
            own = [0]
            while own[-1] < 1 << 50:  # sample k of a walk of N steps: the last record below N; uniform, and stable as N grows
                own.append(int((own[-1] + 1) / rng.random()) + 1)
            self.records.append(np.array(own))

    def steps(self, lengths: np.ndarray) -> np.ndarray:
        """The sampled steps (texts, samples) of texts of so many characters."""
        last = np.maximum(2 * lengths, 1) - 1
        return np.stack([r[np.searchsorted(r, last, "right") - 1] for r in self.records], axis=1)

    def fingerprints(self, texts: list[str]) -> np.ndarray:
        """Sampled bytes (texts, samples)."""
        out = np.zeros((len(texts), len(self.records)), np.uint8)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        while order:
            size, n = 0, 0
            while n < len(order) and (n == 0 or size + len(texts[order[n]]) <= BLOCK):
                size += len(texts[order[n]])
                n += 1
            out[order[:n]] = self._together([texts[i] for i in order[:n]])
            order = order[n:]
        return out

    def _together(self, texts: list[str]) -> np.ndarray:
        """``texts`` longest first."""
        lengths = np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer("\0\0".join([*texts, "\0" * 32]).encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 2)))
        code = ((points * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
        three = points.copy()
        three[:-1] += points[1:] * np.uint32(0x85EBCA6B)
        three[:-2] += points[2:] * np.uint32(0xC2B2AE35)
        three = ((three * np.uint32(0x27D4EB2F)) >> np.uint32(24)).astype(np.uint8)
        wanted = self.steps(lengths)
        flat = wanted.ravel()
        by_step = np.argsort(flat, kind="stable")
        steps = flat[by_step]
        rows, columns = np.divmod(by_step, wanted.shape[1])
        out = np.zeros(wanted.shape, np.uint8)
        place, ends = starts.copy(), starts + lengths
        distinct, at = np.unique(steps, return_index=True)
        at = [*at.tolist(), len(steps)]
        marks = dict(zip(distinct.tolist(), zip(at, at[1:], strict=False), strict=True))
        alive = np.searchsorted(-2 * lengths, -np.arange(2 * int(lengths[0]) + 1), "left") if len(lengths) else []
        for step in range(2 * int(lengths[0])):
            n = alive[step]
            if (mark := marks.get(step)) is not None:
                r, c = rows[mark[0] : mark[1]], columns[mark[0] : mark[1]]
                here = place[r]
                inside = here < ends[r]
                out[r[inside], c[inside]] = three[here[inside]]
            p = place[:n]
            p += self.bits[step % PERIOD].take(code.take(p))
            if not step & 15:
                np.minimum(p, ends[:n], out=p)
        return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _hex(rows: np.ndarray) -> list[str]:
    whole, width = rows.tobytes().hex(), 2 * rows.shape[1]
    return [whole[i : i + width] for i in range(0, len(whole), width)]


def fingerprint(docs: DataFrame, samples: int = SAMPLES, seed: int = 7) -> DataFrame:
    """doc_id, fingerprint: one row for every row of ``docs``."""
    walk = docs.sparkSession.sparkContext.broadcast(Walk(samples, seed))

    def apply(batches):
        for batch in batches:
            prints = walk.value.fingerprints([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_hex(prints), pa.string())], ["doc_id", "fingerprint"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(apply, "doc_id long, fingerprint string")


def in_order(docs: DataFrame, parts: int) -> DataFrame:
    """id, text, tail: partitions are consecutive ranges of rows in order of (id, digest of the text), sorted. After its own rows a partition holds, as
    ``tail``, those that come next: the first of the following range, or the first of all after the last. An id that fills
    several ranges is cut by digest. Ranges, and the tables about them, number at most ``MOST_RANGES``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"x": F.coalesce(F.col("id").cast("double"), F.lit(LAST)), "digest": F.xxhash64("text")})
    parts = min(parts, MOST_RANGES)
    found = Counter(rows.select("x").stat.approxQuantile("x", [i / parts for i in range(1, parts)], 0.2 / parts)) if parts > 1 else Counter()
    cuts = sorted(found)
    # Doubles tell ids apart only up to 2**53: larger ones stay whole.
    times = [found[c] if found[c] > 1 and (abs(c) < 1 << 53 or c == LAST) else 0 for c in cuts]
    starts = np.cumsum([1, *[t + 1 for t in times]]).tolist()
    ranges = docs.sparkSession.createDataFrame([(0, -math.inf, 0, 0)] + [(i + 1, c, t, starts[i]) for i, (c, t) in enumerate(zip(cuts, times, strict=True))], "bucket int, at double, times int, start int")
    if cuts:
        rows = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="x", outputCol="b").transform(rows).withColumn("bucket", F.col("b").cast("int"))
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    share = F.floor((F.col("digest").cast("double") / F.lit(2.0**64) + 0.5) * F.col("times"))
    part = F.col("start") + F.when((F.col("times") > 0) & (F.col("x") == F.col("at")), F.least(share, F.col("times") - 1)).otherwise(F.col("times"))
    placed = rows.join(lookup(ranges), "bucket").select("id", "text", "x", "digest", part.cast("int").alias("part"))
    order = F.struct("x", F.coalesce("id", F.lit(0)).alias("id"), "digest")
    firsts = sorted((r.part, tuple(r.least)) for r in placed.groupBy("part").agg(F.min(order).alias("least")).collect())
    before = [(*least, firsts[i - 1][0]) for i, (_, least) in enumerate(firsts)] or [(0.0, 0, 0, 0)]
    known = docs.sparkSession.createDataFrame(before, "l_x double, l_id long, l_digest long, before int")
    first = (F.col("x") == F.col("l_x")) & (F.coalesce("id", F.lit(0)) == F.col("l_id")) & (F.col("digest") == F.col("l_digest"))
    placed = placed.join(lookup(known), first, "left")
    own, tail = F.struct("part", F.lit(0).alias("tail")), F.struct(F.col("before").alias("part"), F.lit(1).alias("tail"))
    copies = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, tail))
    dealt = placed.select("id", "text", "x", "digest", F.explode(copies).alias("at")).select("id", "text", "x", "digest", "at.part", "at.tail")
    return dealt.repartitionById(starts[-1] + 1, "part").sortWithinPartitions("tail", "x", "id", "digest").select("id", "text", "tail")


def with_neighbours(docs: DataFrame, samples: int = SAMPLES, seed: int = 7) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: every document, its next
    in order of id, and its edited text, in which the start of the next document replaces the last half."""
    spark = docs.sparkSession
    release(spark)  # texts of an earlier call may still lie in shuffle files
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(docs.count() / RANGE))
    walk = spark.sparkContext.broadcast(Walk(samples, seed))

    def answer(ids, texts, prints):
        """Rows of all but the last of ``texts``."""
        edited = []
        for text, after in zip(texts, texts[1:], strict=False):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        others = walk.value.fingerprints(edited)
        digests = [hashlib.sha256(t.encode()).hexdigest() for t in edited]
        columns = [
            pa.array(ids[:-1], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array(digests, pa.string()),
            pa.array(_hex(prints[:-1]), pa.string()),
            pa.array(_hex(others), pa.string()),
            pa.array(likeness(prints[:-1], others), pa.float64()),
            pa.array(likeness(prints[:-1], prints[1:]), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def apply(batches):
        ids, texts, prints, done = [], [], np.zeros((0, samples), np.uint8), False
        for batch in batches:
            tails = batch.column("tail").to_pylist()
            take = len(tails) if not any(tails) else tails.index(1) + 1
            if done:
                continue
            done = take < len(tails) or bool(tails[take - 1])
            fresh = batch.column("text").slice(0, take).to_pylist()
            ids, texts = ids + batch.column("id").slice(0, take).to_pylist(), texts + fresh
            prints = np.concatenate((prints, walk.value.fingerprints(fresh)))
            if len(texts) > 1:
                yield answer(ids, texts, prints)
                ids, texts, prints = ids[-1:], texts[-1:], prints[-1:]

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, parts).mapInArrow(apply, schema)


def _sets(docs: DataFrame, width: int, samples: int, seeds: tuple[int, ...]) -> DataFrame:
    """doc_id, digest, sid, n, counts, print: sets of shingles as ``nearcopies`` has them, and fingerprints as bytes."""
    walks = docs.sparkSession.sparkContext.broadcast([Walk(samples, seed) for seed in seeds])

    def apply(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            grams = [nearcopies.shingles(t, width) for t in texts]
            sids = np.array([xxhash.xxh64_intdigest(g.tobytes(), 1) for g in grams], np.uint64).view(np.int64)
            prints = [r.tobytes() for r in np.concatenate([w.fingerprints(texts) for w in walks.value], axis=1)]
            counts = [nearcopies.cell_counts(g) for g in grams]
            columns = [batch.column("doc_id"), batch.column("digest"), pa.array(sids), pa.array([len(g) for g in grams], pa.int64()), pa.array(counts, pa.binary()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "sid", "n", "counts", "print"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return stored(rows.mapInArrow(apply, "doc_id long, digest long, sid long, n long, counts binary, print binary"))


def near_duplicates(docs: DataFrame, band: int = BAND, width: int = nearcopies.WIDTH, hot: int = nearcopies.HOT, samples: int = SAMPLES, seeds: tuple[int, ...] = (7, 8, 9)) -> DataFrame:
    """doc_id, digest, component_id: one row a document; links are pairs with a common band and a similarity of 0.8 or more.

    Walks that an edit throws out of step may fall into step again late or never, so each of ``seeds`` has walks of its own.
    All pairs under a band's key are verified that size and the numbers of their shingles allow and that aren't connected
    yet; hot keys go through their least set first. Equal sets, and texts without words, are alike.
    """
    found = _sets(docs, width, samples, seeds)
    reps = nearcopies.distinct_sets(found)
    bands = F.array(*[F.xxhash64(F.lit(b), F.substring("print", b * band + 1, band)) for b in range(len(seeds) * samples // band)])
    keys = lambda rows: rows.select(F.explode(F.array_distinct(bands)).alias("gram"), "sid", "n", F.lit(0).cast("long").alias("place"), "label")
    none = reps.select(F.col("sid").alias("a"), F.col("sid").alias("b")).limit(0)
    linked = cut(components(nearcopies.completed(none, reps, keys, docs, width, hot)).select(F.col("node").alias("sid"), F.col("component").alias("label")))
    labelled = found.select("doc_id", "digest", "sid").join(lookup(linked), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return labelled.join(least, "label").select("doc_id", "digest", "component_id")


def edit_near_duplicates(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "component_id")


def op2_edit_embedding(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    return with_neighbours(table(spark, sf_dir, "documents"))
