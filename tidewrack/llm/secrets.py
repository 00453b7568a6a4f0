"""Secret scan: fixed patterns, and probabilistic automata inferred from labelled credentials.

``infer`` builds the prefix tree of the labelled credentials of one format and merges states whose frequencies of
ending and of going on by each symbol agree within Hoeffding's bound (red and blue states, the most frequent blue state
first and into the likeliest compatible red one, never into the start), down to a small automaton: literal parts stay chains, random parts become loops. Every candidate of a text, a run of credential
characters of ``CANDIDATE`` or more, is scored under every format's automaton and under a character-pair model of
ordinary strings; its score is the best format's likelihood ratio in bits a character. Candidates scoring above the
threshold that the labelled ordinary strings set are spans of kind ``grammar``; those inside a base span are not repeated.
Of a candidate that is none as a whole, parts are scored that begin after one of ``BREAKS`` or with a format's fixed
start, and end where its automaton may; those above the threshold of ordinary strings' parts are spans, the likeliest
first, as far as they do not overlap.

Defined cases: a null or empty text has no spans (the digest is that of the empty string); whole texts of any length are
scanned; repeated rows give equal rows; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from tidewrack.llm.rows import slices

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")
ASSIGN_LEAST = 6
LEAST_PART = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
#: Characters after which a part of a candidate may begin.
BREAKS = "=/.+_-"
ALPHA = 0.05
#: Symbols from which on a state counts as a random part.
WIDE = 12
#: Labelled credentials: format, then parts as literal text or (characters, shortest, longest). Publicly documented formats.
ALNUM, URL64, HEXADECIMAL = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", "0123456789abcdef"
FORMATS = {
    "hosting-token": ["gh", ("pousr", 1, 1), "_", (ALNUM, 36, 36)],
    "hosting-project": ["glpat-", (URL64, 20, 20)],
    "cloud-access": [("A", 1, 1), "KIA", (string.ascii_uppercase + "234567", 16, 16)],
    "cloud-key": ["AIza", (URL64, 35, 35)],
    "payment-key": ["sk_live_", (ALNUM, 24, 34)],
    "chat-token": ["xox", ("bpas", 1, 1), "-", (string.digits, 10, 12), "-", (string.digits, 10, 12), "-", (ALNUM, 24, 32)],
    "package-token": ["npm_", (ALNUM, 36, 36)],
    "mail-key": ["SG.", (URL64, 22, 22), ".", (URL64, 43, 43)],
    "signed-claims": ["eyJ", (URL64, 20, 60), ".eyJ", (URL64, 30, 120), ".", (URL64, 40, 50)],
    "digest-key": [(HEXADECIMAL, 32, 40)],
}
LABELLED = 240


def labelled(seed: int = 11, each: int = LABELLED) -> tuple[dict[str, list[str]], list[str]]:
    """Credentials by format, and ordinary strings of the same characters: words, paths, hosts, numbers and dates."""
    rng = random.Random(seed)
    draw = lambda chars, least, most: "".join(rng.choice(chars) for _ in range(rng.randint(least, most)))
    credentials = {name: ["".join(p if isinstance(p, str) else draw(*p) for p in parts) for _ in range(each)] for name, parts in FORMATS.items()}
    syllables = "the ing er tion and re ou st le en an on ti es or ed is be con pro ment al ver ge sch ich que eau cion ado".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    makers = [
        lambda: "".join(word() for _ in range(4)),
        lambda: "_".join(word() for _ in range(rng.randint(2, 5))),
        lambda: "-".join(word() for _ in range(rng.randint(2, 5))),
        lambda: "/".join(word() for _ in range(rng.randint(3, 6))) + rng.choice([".html", ".py", "", "/"]),
        lambda: "www." + ".".join(word() for _ in range(rng.randint(2, 4))) + ".example.com",
        lambda: draw(string.digits, 12, 24),
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}/{word()}-{rng.randint(1, 999)}",
        lambda: rng.choice("=-._") * rng.randint(16, 60),
        lambda: word().capitalize() + word().capitalize() + word().capitalize() + "Factory" + str(rng.randint(1, 9)),
        lambda: word().upper() + "_" + word().upper() + "_" + word().upper(),
    ]
    return credentials, [s for s in (makers[i % len(makers)]() for i in range(each * 4)) if len(s) >= 8]


def infer(examples: list[str], alpha: float = ALPHA) -> list[tuple[dict[str, tuple[int, float]], float]]:
    """States as (symbol -> (next state, bits), bits of ending); state 0 starts. Bits are minus log2 of the probability."""
    moves: list[dict[str, int]] = [{}]
    passed, ended = [0], [0]
    counts: list[dict[str, int]] = [{}]
    for text in examples:
        at = 0
        passed[0] += 1
        for c in text:
            if c not in moves[at]:
                moves[at][c] = len(moves)
                moves.append({})
                counts.append({})
                passed.append(0)
                ended.append(0)
            counts[at][c] = counts[at].get(c, 0) + 1
            at = moves[at][c]
            passed[at] += 1
        ended[at] += 1
    wide = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(x: int, nx: int, y: int, ny: int) -> bool:
        return abs(x / nx - y / ny) > wide * (1 / math.sqrt(nx) + 1 / math.sqrt(ny))

    def compatible(r: int, q: int) -> bool:
        todo = [(r, q)]
        while todo:
            a, b = todo.pop()
            if differ(ended[a], passed[a], ended[b], passed[b]):
                return False
            for c in counts[a].keys() | counts[b].keys():
                if differ(counts[a].get(c, 0), passed[a], counts[b].get(c, 0), passed[b]):
                    return False
                if c in moves[a] and c in moves[b]:
                    todo.append((moves[a][c], moves[b][c]))
        return True

    def fold(r: int, q: int) -> None:
        todo = [(r, q)]
        while todo:
            a, b = todo.pop()
            passed[a] += passed[b]
            ended[a] += ended[b]
            for c, n in counts[b].items():
                counts[a][c] = counts[a].get(c, 0) + n
                if c in moves[a]:
                    todo.append((moves[a][c], moves[b][c]))
                else:
                    moves[a][c] = moves[b][c]

    def likeness(r: int, q: int) -> float:
        """Log-likelihood of what leaves q under r: low counts fit many states, the likeliest is taken."""
        whole = passed[r] + 1.0
        gained = sum(n * math.log((counts[r].get(c, 0) + 0.01) / whole) for c, n in counts[q].items())
        return (gained + ended[q] * math.log((ended[r] + 0.01) / whole)) / passed[q]

    red = [0]
    while True:
        known = set(red)
        blue = max(((counts[p][c], -p, c, q) for p in red for c, q in moves[p].items() if q not in known), default=None)
        if blue is None:
            break
        _, p, c, q = blue
        fit = [r for r in red[1:] if compatible(r, q)]
        if fit:
            r = max(fit, key=lambda r: (likeness(r, q), -r))
            moves[-p][c] = r
            fold(r, q)
        else:
            red.append(q)
    number = {state: i for i, state in enumerate(red)}
    out = []
    for state in red:
        go = {c: (number[moves[state][c]], -math.log2(n / passed[state])) for c, n in counts[state].items()}
        if len(go) >= WIDE:  # a random part: characters of the format that happen to be unseen here go where most go
            usual = Counter(to for to, _ in go.values()).most_common(1)[0][0]
            go = {c: (usual, -math.log2(0.5 / passed[state])) for c in sorted(set("".join(examples)))} | go
        out.append((go, -math.log2(ended[state] / passed[state]) if ended[state] else math.inf))
    return out


def bits(automaton: list, text: str) -> float:
    """Minus log2 of the probability of ``text``; infinite if the automaton can't produce it."""
    at, total = 0, 0.0
    for c in text:
        step = automaton[at][0].get(c)
        if step is None:
            return math.inf
        at = step[0]
        total += step[1]
    return total + automaton[at][1]


class Scorer:
    """Formats' automata, the model of ordinary strings, and the threshold between them."""

    def __init__(self, seed: int = 11):
        credentials, ordinary = labelled(seed)
        self.automata = {name: infer(examples) for name, examples in credentials.items()}
        pairs = Counter((a, b) for s in ordinary for a, b in zip("^" + s, s, strict=False))
        firsts = Counter(a for (a, _), n in pairs.items() for _ in range(n))
        symbols = len(ALNUM) + len("+/_.=-")
        known = {a for a, _ in pairs} | set(ALNUM + "+/_.=-^")
        self.pair_bits = {(a, b): -math.log2((pairs[a, b] + 0.05) / (firsts[a] + 0.05 * symbols)) for a in known for b in ALNUM + "+/_.=-"}
        self.threshold = 0.0
        self.threshold = max([0.0, *(self.score(s)[0] for s in ordinary)])
        self.starts = {name: "".join(takewhile(bool, (p if isinstance(p, str) else p[0] if len(p[0]) == 1 else "" for p in parts))) for name, parts in FORMATS.items()}
        self.part_threshold = self.threshold
        self.part_threshold = max([self.threshold, *(score for s in ordinary for score, *_ in self.scored(s))])

    def scored(self, text: str) -> list[tuple[float, float, int, int]]:
        """(bits a character, bits, start, end) of the part from every start, by format: the longest above the threshold, or the likeliest."""
        broken = {0} | {i + 1 for i, c in enumerate(text) if c in BREAKS}
        out = []
        for name, automaton in self.automata.items():
            fixed, at = self.starts[name], set(broken)
            i = text.find(fixed) if fixed else -1
            while i >= 0:
                at.add(i)
                i = text.find(fixed, i + 1)
            for start in at:
                state, total, plain, before, best = 0, 0.0, 0.0, "^", None
                for end in range(start, len(text)):
                    c = text[end]
                    step = automaton[state][0].get(c)
                    if step is None:
                        break
                    state, total, plain, before = step[0], total + step[1], plain + self.pair_bits[before, c], c
                    gain, size = plain - total - automaton[state][1], end + 1 - start
                    if size >= LEAST_PART and gain > -math.inf and (best is None or gain >= best[1] or gain > self.part_threshold * size):
                        best = (gain / size, gain, start, end + 1)
                if best:
                    out.append(best)
        return out

    def parts(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of the parts above the threshold, in order."""
        out: list[tuple[int, int]] = []
        for score, _, start, end in sorted(self.scored(text), key=lambda p: (-p[1], p[2:])):
            if score > self.part_threshold and all(end <= s or e <= start for s, e in out):
                out.append((start, end))
        return sorted(out)

    def score(self, text: str) -> tuple[float, str | None]:
        """Bits a character in favour of the best format, and its name; minus infinity and None if none can produce it."""
        best, name = min(((bits(a, text), n) for n, a in self.automata.items()), default=(math.inf, None))
        if best == math.inf:
            return -math.inf, None
        plain = sum(self.pair_bits[p] for p in zip("^" + text, text, strict=False))
        return (plain - best) / len(text), name


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) in code points."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str | None, scorer: Scorer) -> tuple[list, list]:
    """Base spans, and spans that only the automata find."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    for m in CANDIDATE.finditer(text):
        found = m[0].rstrip(".=-") if m[0][-1] in ".=-" else m[0]
        if len(found) < 16:
            continue
        start = m.start()
        own = [(0, len(found))] if scorer.score(found)[0] > scorer.threshold else scorer.parts(found)
        added += [(start + i, 3, start + j) for i, j in own if not any(s <= start + i and start + j <= e for s, _, e in base)]
    return base, added


def scan_secrets(docs: DataFrame, seed: int = 11) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_grammar: one row for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(seed))

    def say(spans) -> str:
        return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)

    def apply(batches):
        scorer = shared.value
        for batch in slices(batches):
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column("text").to_pylist():
                base, added = scan(text, scorer)
                n = Counter(k for _, k, _ in base)
                for k in range(3):
                    counts[k].append(n[k])
                counts[3].append(len(added))
                digests.append(hashlib.sha256(say(base).encode()).hexdigest())
                spans.append(say(sorted(base + added)))
            longs = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *longs[:3], pa.array(digests, pa.string()), pa.array(spans, pa.string()), longs[3]], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_grammar"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_grammar long"
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(apply, schema)


def op1_grammar_secrets(spark, sf_dir: str) -> DataFrame:
    from tidewrack.session import table

    return scan_secrets(table(spark, sf_dir, "documents"))
