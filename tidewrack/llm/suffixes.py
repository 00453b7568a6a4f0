"""Removal of repeated byte strings with suffix arrays built per shard.

Every byte under a ``LENGTH``-byte string (a window) that also starts elsewhere goes. Shards are made so that equal
windows meet: a window belongs to its anchor, the first of its ``GRAM``-byte strings with the least hash, so equal windows
have equal anchors. The windows of one anchor are neighbours; the bytes under them are the anchor's string. Anchors whose
gram occurs once in the corpus can hold no repeated window and are left. Equal strings are stored once, with their number;
a gram with one string only is decided by that number. All others go to shards by gram: the strings of a shard are
sorted into a suffix array by Larsson-Sadakane refinement in numpy (prefix doubling on the groups that are not yet
single), Kasai's algorithm gives common prefixes (all strings of a shard advance together), and suffixes joined by prefixes
of ``LENGTH`` bytes or more form classes; a class with two windows or more is repeated. Only windows that an anchor owns
count, so overlapping strings of one document never match themselves.

A gram with more than ``HOT`` strings is dealt to as many shards as that takes. Each has a suffix array of its own, whose
classes are cut into ranges by the digest of their window; the shards' sorted ranges are merged by binary search, and a
class found in two shards or twice in one is repeated. Every string is in one shard, so it has one row of repeated windows.

Defined cases: a null text is an empty one; texts shorter than a window are kept whole; very long texts are taken in
stretches that overlap by a window; rows that repeat in full repeat each other's windows; matches never cross documents;
an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewrack.llm.rows import slices
from tidewrack.session import stored

LENGTH = 400
GRAM = 32
#: Strings of a gram that one shard takes, and shards of a hot gram for each range of their merge.
HOT = 256
MERGED = 4
STRETCH = 1 << 20
SHARD = 1 << 19
_BYTE = np.random.Generator(np.random.PCG64(5)).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: A class of equal windows of a shard: digest, number of windows, shard, number in the shard.
CLASS = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("n", "<i8"), ("part", "<i8"), ("at", "<i4")])


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    h, width = _BYTE[data], 1
    while width < GRAM:
        h = h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def window_anchors(grams: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The place of the anchor of each window: least hash, then first. At most 2**24 grams."""
    wide = length - GRAM + 1
    n = len(grams) - wide + 1
    keyed = (grams & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(grams) // wide) * wide, np.iinfo(np.uint64).max)
    padded[: len(grams)] = keyed
    rows = padded.reshape(-1, wide)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(onward[:n], upto[wide - 1 : wide - 1 + n]) & np.uint64(0xFFFFFF)).astype(np.int64)


def strings(texts: list[bytes], length: int = LENGTH):
    """(text, first window, windows, gram hash) arrays: the anchors' strings of all texts."""
    stretches = [(i, at, t[at : at + STRETCH + length - 1]) for i, t in enumerate(texts) for at in range(0, max(0, len(t) - length + 1), STRETCH)]
    out = []
    while stretches:
        size, k = 0, 0
        while k < len(stretches) and (k == 0 or size + len(stretches[k][2]) <= 2 * STRETCH):
            size += len(stretches[k][2])
            k += 1
        part, stretches = stretches[:k], stretches[k:]
        grams = gram_hashes(np.frombuffer(b"".join(s for *_, s in part), np.uint8))
        anchors = window_anchors(grams, length)
        lengths = np.array([len(s) for *_, s in part])
        starts = np.cumsum(lengths) - lengths
        windows = lengths - length + 1
        owner = np.repeat(np.arange(k), windows)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + starts[owner]
        own = anchors[place]
        first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (owner[1:] != owner[:-1]))))
        count = np.diff(np.concatenate((first, [len(own)])))
        who = owner[first]
        texts_of, offset = np.array([i for i, *_ in part]), np.array([at for _, at, _ in part])
        out.append((texts_of[who], place[first] - starts[who] + offset[who], count, grams[own[first]].view(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 4


def suffix_array(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all suffixes and the rank of each. Groups of equal prefixes are refined by the rank a prefix further on;
    a group that is single is never sorted again."""
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i : i + n]
    if n < 8 or (data[-8:] == 0).any():  # the padding must sort below any byte: the shorter suffix first
        key_end = np.minimum(8, n - np.arange(n))
        order = np.lexsort((key_end, key))
        fresh = np.concatenate(([True], (key[order][1:] != key[order][:-1]) | (key_end[order][1:] != key_end[order][:-1])))
    else:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        fresh = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    width = 8
    single = fresh & np.concatenate((fresh[1:], [True]))
    open_at = np.flatnonzero(~single)
    while len(open_at):
        group = order[open_at]
        onward = group + width
        further = np.where(onward < n, rank[np.minimum(onward, n - 1)], -1)
        head = rank[group]
        by = np.argsort(head * (n + 1) + further + 1, kind="stable")
        group, head, further = group[by], head[by], further[by]
        order[open_at] = group
        fresh = np.concatenate(([True], (head[1:] != head[:-1]) | (further[1:] != further[:-1])))
        starts = np.maximum.accumulate(np.where(fresh, np.arange(len(group)), 0))
        rank[group] = open_at[starts]
        single = fresh & np.concatenate((fresh[1:], [True]))
        open_at = open_at[~single]
        width *= 2
    return order, rank


def common_prefixes(data: np.ndarray, order: np.ndarray, rank: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in order. Kasai's algorithm on all stretches [starts, ends) at
    once: from one place to the next a prefix shrinks by one at most."""
    n = len(data)
    before = np.where(rank > 0, order[rank - 1], -1)
    out = np.zeros(n, np.int64)
    padded = np.concatenate((data, np.zeros(1, data.dtype)))
    place, have, lanes = starts.copy(), np.zeros(len(starts), np.int64), np.arange(len(starts))
    while len(lanes):
        i, h = place[lanes], have[lanes]
        j = before[i]
        goes = (j >= 0) & (i + h < n) & (j + h < n)
        goes &= padded[np.minimum(i + h, n)] == padded[np.clip(j + h, 0, n)]
        have[lanes] = h + goes
        done = lanes[~goes]
        at = place[done]
        out[rank[at]] = have[done]
        have[done] = np.maximum(have[done] - 1, 0)
        place[done] = at + 1
        if len(done) and (place[done] >= ends[done]).any():
            lanes = lanes[place[lanes] < ends[lanes]]
    return out


def window_classes(parts: list[bytes], owned: list[int], times: list[int], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the owned windows of all strings, one after the other: place in the joined strings, class of equal windows, and
    how often the class occurs, strings counting ``times``."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    lengths = np.array([len(p) for p in parts])
    starts = np.cumsum(lengths) - lengths
    order, rank = suffix_array(data)
    prefixes = common_prefixes(data, order, rank, starts, starts + lengths)
    classes = np.cumsum(prefixes < length)
    owned_n = np.array(owned)
    windows = np.repeat(starts, owned_n) + np.arange(owned_n.sum()) - np.repeat(np.cumsum(owned_n) - owned_n, owned_n)
    of = classes[rank[windows]]
    return windows, of, np.bincount(of, np.repeat(np.array(times), owned_n))[of].astype(np.int64)


def merged_classes(shards: list[np.ndarray]) -> np.ndarray:
    """The classes that occur twice or more among all ``shards``, each of them sorted by (w1, w2)."""
    keys = [s["w1"] for s in shards]
    every = np.unique(np.concatenate(keys))
    total = np.zeros(len(every), np.int64)
    places = [np.searchsorted(every, k) for k in keys]
    for s, at in zip(shards, places, strict=True):
        np.add.at(total, at, s["n"])
    found = np.concatenate([s[total[at] >= 2] for s, at in zip(shards, places, strict=True)])
    # The second half of the digest settles what shares the first.
    found = found[np.lexsort((found["w2"], found["w1"]))]
    fresh = np.concatenate(([True], (found["w1"][1:] != found["w1"][:-1]) | (found["w2"][1:] != found["w2"][:-1])))[: len(found)]
    number = np.cumsum(fresh) - 1
    return found[np.bincount(number, found["n"])[number] >= 2] if len(found) else found


def _spans(windows: np.ndarray) -> bytes:
    """Runs of neighbouring windows as pairs (first, after the last)."""
    if not len(windows):
        return b""
    windows = np.sort(windows)
    breaks = np.flatnonzero(np.diff(windows) > 1)
    return np.stack((windows[np.concatenate(([0], breaks + 1))], windows[np.concatenate((breaks, [len(windows) - 1]))] + 1), axis=1).astype("<i8").tobytes()


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _strings_of(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, digest, start, count, gram, s1, s2: one row a string."""

    def apply(batches):
        for batch in slices(batches):
            texts = [_bytes(t) for t in batch.column("text").to_pylist()]
            who, start, count, gram = strings(texts, length)
            digests = [xxhash.xxh3_128_digest(memoryview(texts[w])[s : s + c + length - 1]) for w, s, c in zip(who.tolist(), start.tolist(), count.tolist(), strict=True)]
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            rows = pa.array(who)
            arrays = [batch.column("doc_id").take(rows), batch.column("digest").take(rows), *(pa.array(x) for x in (start, count, gram, halves[:, 0], halves[:, 1]))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "digest", "start", "count", "gram", "s1", "s2"])

    return docs.mapInArrow(apply, "doc_id long, digest long, start long, count long, gram long, s1 long, s2 long")


def _dealt(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """gram, part, parts, s1, s2, n, count, data: the strings with their bytes; part is -1 where a gram has one shard."""
    fields = ["gram", "part", "parts", "s1", "s2", "n", "count"]
    by_document = wanted.groupBy("doc_id", "digest").agg(F.collect_list(F.struct(*fields, "start")).alias("wanted"))
    w = by_document.withColumnsRenamed({"doc_id": "w_id", "digest": "w_digest"})
    joined = docs.join(w, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("digest") == F.col("w_digest"))).select("text", "wanted")

    def apply(batches):
        for batch in batches:
            rows: list[tuple] = []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                data = memoryview(_bytes(text))
                rows += [(*(x[f] for f in fields), bytes(data[x["start"] : x["start"] + x["count"] + length - 1])) for x in wanted]
            yield _batch(rows, [*fields, "data"])

    return joined.mapInArrow(apply, "gram long, part long, parts long, s1 long, s2 long, n long, count long, data binary")


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    """Longs, and bytes in the last column."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    kinds = [pa.int64()] * (len(names) - 1) + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _keyed_groups(batches, columns: int, size: int = 0):
    """Rows with equal first ``columns``, sorted by them; several such groups at once up to ``size`` bytes of the last column."""
    held: list[tuple] = []
    have, last = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
            if row[:columns] != last and held and have >= size:
                yield held
                held, have = [], 0
            last = row[:columns]
            held.append(row)
            have += len(row[-1])
    if held:
        yield held


#: Rows of ``_classed``: spans of a string; classes of a string of a hot gram; a range (numbers from 0) of a shard's classes.
SPANS, CLASSES = -2, -1


def _classed(dealt: DataFrame, length: int) -> DataFrame:
    """gram, part, s1, s2, range, data: what the suffix array of each shard says, see SPANS and CLASSES."""
    names = ["gram", "part", "s1", "s2", "range", "data"]

    def ranged(gram: int, part: int, parts: int, windows: np.ndarray, of: np.ndarray, times: np.ndarray, joined: bytes):
        """Rows of the ranges of one shard, and the number of each window's class in them."""
        _, first, at = np.unique(of, return_index=True, return_inverse=True)
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[i : i + length]) for i in windows[first].tolist()), "<u8").reshape(-1, 2)
        own = np.empty(len(first), CLASS)
        own["w1"], own["w2"], own["n"], own["part"], own["at"] = digests[:, 0], digests[:, 1], np.bincount(at, times), part, np.arange(len(first))
        own = np.sort(own, order=["w1", "w2"])
        ranges = -(-parts // MERGED)
        cuts = np.searchsorted(own["w1"], np.array([(r << 64) // ranges for r in range(1, ranges)], np.uint64))
        return [(gram, part, None, None, r, x.tobytes()) for r, x in enumerate(np.split(own, cuts)) if len(x)], at

    def apply(batches):
        for held in _keyed_groups(batches, 2, SHARD):
            joined = b"".join(r[7] for r in held)
            windows, of, weight = window_classes([r[7] for r in held], [r[6] for r in held], [r[5] for r in held], length)
            ends = np.cumsum([r[6] for r in held])
            rows, at = [], 0
            while at < len(held):
                gram, part, parts = held[at][:3]
                upto = next((i for i in range(at, len(held)) if held[i][:2] != (gram, part)), len(held))
                lo = ends[at] - held[at][6]
                if part < 0:
                    found = ((r, _spans(np.flatnonzero(weight[e - r[6] : e] >= 2))) for r, e in zip(held[at:upto], ends[at:upto], strict=True))
                    rows += [(gram, part, r[3], r[4], SPANS, spans) for r, spans in found if spans]
                else:
                    own = slice(lo, ends[upto - 1])
                    times = np.repeat([r[5] for r in held[at:upto]], [r[6] for r in held[at:upto]])
                    more, numbers = ranged(gram, part, parts, windows[own], of[own], times, joined)
                    rows += more
                    rows += [(gram, part, r[3], r[4], CLASSES, numbers[e - lo - r[6] : e - lo].astype("<i4").tobytes()) for r, e in zip(held[at:upto], ends[at:upto], strict=True)]
                at = upto
            yield _batch(rows, names)

    placed = dealt.repartition("gram", "part").sortWithinPartitions("gram", "part")
    return placed.mapInArrow(apply, "gram long, part long, s1 long, s2 long, range long, data binary")


def _repeated_classes(classed: DataFrame) -> DataFrame:
    """gram, part, data: the numbers of a shard's classes that are repeated, from each range of them."""

    def apply(batches):
        for held in _keyed_groups(batches, 2):
            found = merged_classes([np.frombuffer(r[3], CLASS) for r in held])
            by_part = found[np.argsort(found["part"], kind="stable")]
            parts, first = np.unique(by_part["part"], return_index=True)
            yield _batch([(held[0][0], p, x.astype("<i4").tobytes()) for p, x in zip(parts.tolist(), np.split(by_part["at"], first[1:]), strict=bool(len(parts)))], ["gram", "part", "data"])

    ranges = classed.filter("range >= 0").select("gram", "range", "part", "data").repartition("gram", "range").sortWithinPartitions("gram", "range")
    return ranges.mapInArrow(apply, "gram long, part long, data binary")


def _resolved(dealt: DataFrame, length: int) -> DataFrame:
    """gram, s1, s2, spans: the repeated windows of each string that has some, one row a string."""
    classed = stored(_classed(dealt, length))

    def apply(batches):
        for held in _keyed_groups(batches, 2):
            again = np.concatenate([np.frombuffer(r[5], "<i4") for r in held if r[2] == 0] or [np.empty(0, "<i4")])
            found = ((r, _spans(np.flatnonzero(np.isin(np.frombuffer(r[5], "<i4"), again)))) for r in held if r[2] == 1)
            yield _batch([(r[0], r[3], r[4], spans) for r, spans in found if spans], ["gram", "s1", "s2", "spans"])

    numbers = _repeated_classes(classed).selectExpr("gram", "part", "0 kind", "cast(null as long) s1", "cast(null as long) s2", "data")
    strings = classed.filter(F.col("range") == CLASSES).selectExpr("gram", "part", "1 kind", "s1", "s2", "data")
    placed = numbers.union(strings).repartition("gram", "part").sortWithinPartitions("gram", "part", "kind")
    hot = placed.mapInArrow(apply, "gram long, s1 long, s2 long, spans binary")
    return hot.union(classed.filter(F.col("range") == SPANS).select("gram", "s1", "s2", F.col("data").alias("spans")))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, digest, found (start of a string, its spans): one row a document that has repeated windows. ``docs`` has
    doc_id, digest of the text, text."""
    own = ["gram", "s1", "s2"]
    every = stored(_strings_of(docs, length))
    distinct = every.groupBy(*own).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "digest", "start", "count")).alias("f"))
    distinct = stored(distinct.select(*own, "n", "f.doc_id", "f.digest", "f.start", "f.count"))
    grams = distinct.groupBy("gram").agg(F.count("*").alias("k"), F.sum("n").alias("total")).filter("total > 1").select("gram", "k")
    shared = stored(distinct.join(grams, "gram"))
    alone = shared.filter("k = 1").select(*own, F.lit(None).cast("binary").alias("spans"))
    parts = F.ceil(F.col("k") / HOT).cast("long")
    placed = shared.filter("k > 1").withColumn("parts", parts).withColumn("part", F.when(F.col("parts") > 1, F.pmod("s1", "parts")).otherwise(-1))
    resolved = _resolved(_dealt(docs, placed, length), length)
    spans = stored(alone.union(resolved))
    found = every.join(spans, own).select("doc_id", "digest", F.struct("start", "count", "spans").alias("s"))
    return found.groupBy("doc_id", "digest").agg(F.collect_list("s").alias("found"))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay): one row for every row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    found = repeated_spans(docs, length).withColumnsRenamed({"doc_id": "f_id", "digest": "f_digest"})
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("digest") == F.col("f_digest")), "left").select("doc_id", "text", "found")

    def apply(batches):
        for batch in slices(batches):
            columns: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist(), strict=True):
                data = np.frombuffer(_bytes(text), np.uint8)
                step = np.zeros(len(data) + 1, np.int64)
                for x in found or ():
                    pairs = np.array([[0, x["count"]]]) if x["spans"] is None else np.frombuffer(x["spans"], "<i8").reshape(-1, 2)
                    np.add.at(step, pairs[:, 0] + x["start"], 1)
                    np.add.at(step, pairs[:, 1] + x["start"] + length - 1, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = data[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                for column, value in zip(columns, (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op5_suffix_arrays(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
