"""Near-duplicate detection: 64-bit SimHash of word shingles and a self-join of the fingerprints' binary trie.

Texts become fingerprints in numpy, one pass a text. Two fingerprints within ``BITS`` differing bits agree on at least
two of four 16-bit quarters, so each distinct fingerprint is sent under its six pairs of quarters; groups of one pair
are joined by walking the trie of their sorted fingerprints against itself: node pairs carry the bits in which they
surely differ and are left once these exceed the budget. A group of more than ``HOT`` fingerprints is split further, by
thirds of its free bits (one of three agrees within the budget), so a task's group stays below 2**22 fingerprints. From
a group come the links of a spanning forest, not all pairs; connected components of those links are the classes.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and link like any other; rows that
repeat share fingerprint and component; a class whose ids are all null has a null component. An empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewrack.llm.rows import OTHERS, shielded, slices
from tidewrack.operators.components import components
from tidewrack.session import cut, lookup, release

SHINGLE = 3
BITS = 2
SEED = 42
HOT = 4096
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at once.
_CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned; ASCII white space separates words, and a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    n = max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the ``hashes``."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, digest (of the text), fp, the fingerprint as a signed long: one row for every row of ``docs``."""

    def apply(batches):
        for batch in slices(batches):
            found = np.array([fingerprint(t, width) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(found, pa.int64())], ["doc_id", "digest", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(apply, "doc_id long, digest long, fp long")


def trie_links(values: list[int], budget: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``budget`` bits between the sorted, distinct, unsigned ``values``.

    A trie node is a range of ``values`` with a common prefix. Once a subtree is one component it needs only one link
    to another such subtree, so large groups of close fingerprints do not cost all their pairs.
    """
    parent = list(range(len(values)))
    one: dict[tuple[int, int], bool] = {}
    links: list[tuple[int, int]] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def split(lo: int, hi: int) -> int:
        bit = 1 << ((values[lo] ^ values[hi - 1]).bit_length() - 1)
        a, b = lo, hi
        while a < b:
            mid = (a + b) // 2
            if values[mid] & bit:
                b = mid
            else:
                a = mid + 1
        return a

    def whole(node: tuple[int, int]) -> bool:
        if node[1] - node[0] == 1 or one.get(node):
            return True
        root = find(node[0])
        if found := all(find(i) == root for i in range(*node)):
            one[node] = True
        return found

    def cross(first: tuple[int, int], second: tuple[int, int]) -> None:
        stack = [(first, second)]
        single = whole(first) and whole(second)
        while stack:
            a, b = stack.pop()
            wide = max((values[a[0]] ^ values[a[1] - 1]).bit_length(), (values[b[0]] ^ values[b[1] - 1]).bit_length())
            if ((values[a[0]] ^ values[b[0]]) >> wide).bit_count() > budget:
                continue
            if single and find(a[0]) == find(b[0]):
                return
            if not wide:
                x, y = find(a[0]), find(b[0])
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    links.append((values[a[0]], values[b[0]]))
                continue
            if (values[a[0]] ^ values[a[1] - 1]).bit_length() == wide:
                mid = split(*a)
                stack += [((a[0], mid), b), ((mid, a[1]), b)]
            else:
                mid = split(*b)
                stack += [(a, (b[0], mid)), (a, (mid, b[1]))]

    todo = [((0, len(values)), False)] if len(values) > 1 else []
    while todo:
        (lo, hi), joined = todo.pop()
        mid = split(lo, hi)
        if joined:
            cross((lo, mid), (mid, hi))
        else:
            todo.append(((lo, hi), True))
            todo += [(x, False) for x in ((lo, mid), (mid, hi)) if x[1] - x[0] > 1]
    return links


def _keys() -> F.Column:
    """The six pairs of quarters, each as (number of the pair, its 32 bits)."""
    quarter = [F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    return F.array(*[F.struct(F.lit(n).alias("kind"), (quarter[i] * 65536 + quarter[j]).alias("key")) for n, (i, j) in enumerate(combinations(range(4), 2))])


def _thirds() -> F.Column:
    """For a hot group: each third of the 32 bits that its key leaves free."""
    out = []
    for n, fixed in enumerate(combinations(range(4), 2)):
        i, j = (q for q in range(4) if q not in fixed)
        free = F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF)) * 65536 + F.shiftrightunsigned("fp", 16 * j).bitwiseAND(F.lit(0xFFFF))
        parts = [F.shiftright(free, at).bitwiseAND(F.lit((1 << size) - 1)) + (third << 11) for third, (at, size) in enumerate(((0, 11), (11, 11), (22, 10)))]
        out.append(F.when(F.col("kind") == n, F.array(*parts)))
    return F.coalesce(*out)


def links(fps: DataFrame, budget: int = BITS, hot: int = HOT) -> DataFrame:
    """a, b: links that connect the distinct fingerprints ``fps.fp`` exactly as all links within the budget (up to 2) do."""
    if budget > 2:
        raise ValueError("quarters in pairs find up to two differing bits")
    keyed = cut(fps.select("fp", F.explode(_keys()).alias("k")).select("fp", "k.kind", "k.key"))
    sizes = keyed.groupBy("kind", "key").agg(F.count("*").alias("n")).filter("n > 1")
    sized = keyed.join(sizes, ["kind", "key"])
    grouped = sized.select("fp", "kind", "key", F.explode(F.when(F.col("n") > hot, _thirds()).otherwise(F.array(F.lit(-1).cast("long")))).alias("part"))
    placed = grouped.repartition("kind", "key", "part").sortWithinPartitions("kind", "key", "part")

    def apply(batches):
        held, group = None, []

        def linked():
            return trie_links(sorted({v & (1 << 64) - 1 for v in group}), budget)

        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("kind", "key", "part", "fp")]
            for *name, fp in zip(*columns, strict=True):
                if name != held:
                    found += linked()
                    held, group = name, []
                group.append(fp)
            yield packed(found)
        yield packed(linked())

    def packed(found):
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return placed.mapInArrow(apply, "a long, b long")


def classes(fingerprints: DataFrame, budget: int = BITS) -> DataFrame:
    """fp, label, component_id: one row a distinct fingerprint of ``fingerprints`` (doc_id, fp)."""
    distinct = cut(fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct, budget)).select(F.col("node").alias("fp"), F.col("component").alias("label"))
    labelled = distinct.join(found, "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    return labelled.select("fp", "label").join(least, "label")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, budget: int = BITS) -> DataFrame:
    """doc_id, digest, fp, label, component_id: one row a document."""
    fingerprints = cut(with_fingerprint(docs, width))
    return fingerprints.join(lookup(cut(classes(fingerprints, budget))), "fp").select("doc_id", "digest", "fp", "label", "component_id")


def one_of_each(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each label in ``labelled`` (doc_id, digest, label) the smallest doc_id, a null one
    last, then the smallest digest of the text; of rows equal in both, one. Texts don't move if few rows go, else once."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    heads = labelled.groupBy("label").agg(F.min(order).alias("h"))
    keyed = labelled.groupBy("doc_id", "digest").agg(F.first("label").alias("label"), F.count("*").alias("rows")).join(heads, "label")
    key = lambda i, d: F.xxhash64(i.isNull(), i, d)
    # What goes as a whole, and what stays once of several rows; all of one key in a row.
    odd = keyed.select(key(F.col("doc_id"), F.col("digest")).alias("o_key"), F.struct("doc_id", "digest", (order == F.col("h")).alias("stays"), "rows").alias("o")).filter("NOT o.stays OR o.rows > 1")
    odd = cut(odd.groupBy("o_key").agg(F.collect_list("o").alias("odd")))
    release(docs.sparkSession)  # texts that were moved to find the labels may still lie in shuffle files
    small = lookup(odd)
    rows, restored = shielded(docs, "doc_id", "text")
    rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("l_id", F.col("doc_id").cast("long")).withColumn("key", key(F.col("l_id"), F.col("digest")))
    own = F.filter("odd", lambda o: (o["digest"] == F.col("digest")) & o["doc_id"].eqNullSafe(F.col("l_id")))
    left = rows.join(small, F.col("key") == F.col("o_key"), "left").withColumn("own", F.get(own, F.lit(0))).drop("odd")
    left = left.filter(F.coalesce("own.stays", F.lit(True)))
    # By key first: rows that were dealt out by it for the join are not moved again.
    nth = F.row_number().over(Window.partitionBy("key", "l_id", "digest").orderBy(F.xxhash64(OTHERS)))
    if small is odd:
        return restored(left.withColumn("nth", nth).filter("nth = 1"))
    once = left.filter("own.rows IS NOT NULL").withColumn("nth", nth).filter("nth = 1").drop("nth")
    return restored(left.filter("own.rows IS NULL").union(once))


def keep_one(docs: DataFrame, width: int = SHINGLE, budget: int = BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates by fingerprint alone; every text is fingerprinted once."""
    return one_of_each(docs, near_duplicates(docs, width, budget))


def op8_simhash_trie(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
