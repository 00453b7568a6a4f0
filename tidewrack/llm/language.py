"""Language identification by cross-parsing entropy over suffix automata.

For every language a bounded sample of labelled texts (``SAMPLE_DOCS`` rows that differ in id or text, ``SAMPLE_CHARS``
characters) is turned into a suffix automaton, which accepts exactly the substrings of the sample. A text gives one stretch of the same length as the
others', at a place drawn by its digest. All automata together take at most ``MODEL_BYTES``: beyond some twenty
languages samples get shorter. A text is cut greedily into the longest
phrases that the automaton accepts; the language with the fewest phrases, each weighed by the bits it takes to name a
place in that language's sample, wins. Whole texts are parsed, in stretches of ``STRETCH`` symbols (a phrase ends at
the end of a stretch), and all stretches of a batch advance together in numpy, one symbol a step.

Symbols: lower-cased letters; anything else separates, runs of separators count once. The ``OWN_SYMBOLS`` most frequent
letters of the samples have symbols of their own, others share ``SHARED_SYMBOLS`` by code point. An automaton's table
is as wide as the symbols of its own sample.

Defined cases: a null text, an empty text or one without any letter is ``und`` with score 0; so is every text if no
labelled text can be learned from. Ties between languages go to the smaller name. Rows that repeat are predicted alike.
Other columns pass through; columns named like the outputs are replaced.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewrack.llm.rows import slices

SAMPLE_DOCS = 64
SAMPLE_CHARS = 32_000
MODEL_BYTES = 192 << 20
OWN_SYMBOLS = 63
SHARED_SYMBOLS = 16
STRETCH = 1024
BLOCK = 4_000_000
UNKNOWN = "und"


def held_out(doc_id) -> F.Column:
    """Rows that a model must not learn from."""
    return F.coalesce((F.crc32(doc_id.cast("string").cast("binary")) % 3) == 1, F.lit(False))


def sample(docs: DataFrame, docs_per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(lang, stretch) of the labelled rows, not held out, with the smallest digests of id and text: at most so many a
    language, so many characters in all of them. Rows that repeat count once, and ids may be null."""
    key = F.xxhash64(F.col("doc_id").cast("string"), "text")
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")).select("lang", key.alias("key"), "text")
    order = Window.partitionBy("lang").orderBy("key")
    keys = labelled.select("lang", "key").withColumn("nth", F.dense_rank().over(order)).filter(F.col("nth") <= docs_per_language).select("lang", "key").distinct().collect()
    if not keys:
        return []
    each = {lang: max(1, chars // n) for lang, n in Counter(r.lang for r in keys).items()}
    size = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(n)) for lang, n in sorted(each.items())])
    start = F.pmod(F.col("key"), F.greatest(F.lit(1), F.length("text") - size + 1)).cast("int") + 1
    rows = labelled.filter(F.col("key").isin([r.key for r in keys])).dropDuplicates(["lang", "key"]).select("lang", "key", F.substring("text", start, size).alias("text")).collect()
    wanted = {(r.lang, r.key) for r in keys}
    return [(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r.key)) if (r.lang, r.key) in wanted]


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """Transitions of the suffix automaton of ``symbols`` as one flat table.

    Entry ``state * width + symbol`` holds ``4 * width * next + ended``. Where a state has no such transition, a phrase
    has ended (1) and the symbol starts the next one from the root; a symbol that the sample lacks is a phrase of its own
    (1 more, or 1 at the root) and leaves the parse at the root.
    """
    link, length, moves, last = [-1], [0], [{}], 0
    for s in symbols:
        now = len(link)
        length.append(length[last] + 1)
        link.append(0)
        moves.append({})
        p = last
        while p != -1 and s not in moves[p]:
            moves[p][s] = now
            p = link[p]
        if p != -1:
            q = moves[p][s]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                moves.append(dict(moves[q]))
                while p != -1 and moves[p].get(s) == q:
                    moves[p][s] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    root = np.full(width, 2, np.int64)
    for s, to in moves[0].items():
        root[s] = to * (4 * width) + 1
    flat = np.tile(root, len(moves)).reshape(len(moves), width)
    flat[0] = 1
    for state, out in enumerate(moves):
        for s, to in out.items():
            flat[state, s] = to * (4 * width)
    return flat.astype(np.int32).ravel()


def to_symbols(text: str, table: np.ndarray) -> np.ndarray:
    s = table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    gap = s == 0
    if len(s) > 1:
        s = s[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
    return s


def train(samples: list[tuple[str, str]], chars: int = SAMPLE_CHARS, most_bytes: int = MODEL_BYTES) -> dict:
    """Symbol table and, by language in order of name, automaton, bits a phrase and the language's own symbols."""
    texts: dict[str, list[str]] = {}
    for lang, text in samples:
        texts.setdefault(lang, []).append(text.lower())
    counts = Counter(c for own in texts.values() for t in own for c in t if c.isalpha())
    own = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:OWN_SYMBOLS]]
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        if unicodedata.category(chr(point))[0] == "L":
            table[point] = 1 + len(own) + point % SHARED_SYMBOLS
    for i, c in enumerate(own):
        table[ord(c)] = 1 + i
    width = 1 + len(own) + SHARED_SYMBOLS
    models = []
    for lang in sorted(texts):
        every = [to_symbols(t, table) for t in texts[lang]]
        used = np.unique(np.concatenate([np.zeros(1, np.uint8), *every]))
        # At most two states a symbol, four bytes an entry; one column more for symbols that the sample lacks.
        most = min(chars, most_bytes // (len(texts) * 8 * (len(used) + 1)))
        each = max(1, most // len(every))
        named = np.full(width, len(used), np.uint8)
        named[used] = np.arange(len(used))
        symbols = named[np.concatenate([np.concatenate((s[:each], np.zeros(1, np.uint8))) for s in every])]
        models.append((lang, automaton(symbols.tolist(), len(used) + 1), math.log2(len(symbols) + 1), named))
    return {"table": table, "width": width, "models": models}


def phrases(stretches: list[np.ndarray], flat: np.ndarray, grid: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """Phrases of each stretch; stretches are sorted by length, longest first, and stand in the columns of ``grid``."""
    state = np.zeros(len(stretches), np.int32)
    ended = np.zeros(len(stretches), np.int32)
    for step in range(grid.shape[0]):
        n = alive[step]
        v = flat.take(state[:n] + grid[step, :n])
        ended[:n] += v & 3
        state[:n] = v >> 2
    return ended + (state != 0)


def parse(texts: list[str | None], model: dict) -> list[tuple[str, float]]:
    """Language and score of each text."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    block: list[tuple[int, np.ndarray]] = []
    size = 0

    def flush() -> None:
        nonlocal block, size
        stretches = [(i, s[at : at + STRETCH]) for i, s in block for at in range(0, len(s), STRETCH)]
        stretches.sort(key=lambda x: -len(x[1]))
        parts = [s for _, s in stretches]
        owner = np.array([i for i, _ in stretches])
        lengths = np.array([len(s) for s in parts])
        grid = np.zeros((lengths[0], len(parts)), np.uint8)
        for k, s in enumerate(parts):
            grid[: len(s), k] = s
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        bits = []
        for _, flat, weight, named in model["models"]:
            total = np.bincount(owner, phrases(parts, flat, named[grid], alive), minlength=owner.max() + 1)
            bits.append(total * weight)
        for i, _ in block:
            ranked = sorted((b[i], name) for b, (name, *_) in zip(bits, model["models"], strict=True))
            second = ranked[1][0] if len(ranked) > 1 else 0.0
            out[i] = (ranked[0][1], float(1 - ranked[0][0] / second) if second else 1.0)
        block, size = [], 0

    for i, text in enumerate(texts):
        if not text or not model["models"]:
            continue
        s = to_symbols(text, model["table"])
        if not s.any():
            continue
        block.append((i, s))
        size += len(s)
        if size >= BLOCK:
            flush()
    if block:
        flush()
    return out


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and score; needs a column text."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def apply(batches):
        for batch in slices(batches):
            found = parse(batch.column("text").to_pylist(), shared.value)
            langs, scores = pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, langs, scores], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(apply, schema)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, train(sample(docs)))


def op9_cross_parsing(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(sample(docs))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
