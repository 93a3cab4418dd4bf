"""Secret scans: format grammars inferred from labelled credentials.

Base spans are the leftmost non-overlapping matches of three patterns; matches
that fail a length are dropped.  The values found are the labelled credentials.

From a bounded sample of each kind (``sample``, by a hash of the value) a prefix
tree over character classes is built, and its states are merged where their
outgoing frequencies are statistically compatible (Hoeffding's bound, applied
to the futures too, as ALERGIA does, and to the lengths still to come, so that
formats of fixed length keep it), which gives a probabilistic automaton.
The tree is ``DEPTH`` symbols deep; what lies beyond is counted in the merged
states that it runs through.  Tokens are scored whole, at any length.
Each maximal run of 6 or more credential characters, the shortest labelled
length, is a candidate, whatever it is made of, and so is the value of every
base span: all are scored.  The score is the format likelihood, the mean log2
probability of the token's classes under the best automaton.  A candidate outside
base spans becomes a span of kind ``format`` when, for one automaton, its score is
above the mean under the class bigrams of all ordinary tokens and typical of the
labelled credentials: no lower than all but ``miss`` of their own scores, and no
higher than all but ``miss``, which plainer tokens than these reach (a run of
digits under a grammar of hexadecimal keys).

Classes keep upper and lower case apart: a digit, a to f, g to z, A to F, G to Z,
each sign as itself, and ``?`` for all outside ASCII, which no candidate holds.

Defined cases: null text is empty; texts and tokens of any length are read and
scored whole; without labelled credentials only base spans are found, with no
score; a candidate inside a base span is covered by it; repeated rows get the
same spans; an empty table has no rows; the result column replaces one of the
same name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettergraph.shared import written

# The base patterns and least lengths, kinds in the order of the report.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = (*LEAST, "format")
_CANDIDATE = re.compile(r"[0hzHZ+/_.=-]{6,}")  # over classes: maximal runs of credential characters, from the shortest labelled length on

SAMPLE = 3_000
ALPHA = 0.05
MISS = 0.02
DEPTH = 80  # of the prefix tree
_LONG_HEX = re.compile(r"[0h]{24,}")  # over classes; runs are maximal, so these are the runs of HEX that are long enough
_NAMES = (b"passw", b"secret", b"token", b"apikey", b"api_key")  # every match of ASSIGN holds one of these in lower case
_CLASSES = bytes.maketrans(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0" * 10 + b"h" * 6 + b"z" * 20 + b"H" * 6 + b"Z" * 20)
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
_WORDS = pa.schema([("kind", pa.string()), ("word", pa.string()), ("h", pa.int64()), ("n", pa.int64())])
_SPANS_TYPE = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def symbols(text: str) -> str:
    """Character classes, one a code point: 0 digit, h and H hexadecimal letters, z and Z other letters, ? outside ASCII, any other as it is."""
    return text.encode("ascii", "replace").translate(_CLASSES).decode("ascii")


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind."""
    found, plain = [], text.encode("ascii", "replace").lower()
    if any(name in plain for name in _NAMES):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end(), text[m.start() : m.end()]) for m in _LONG_HEX.finditer(symbols(text))]
    return [(KINDS[k], s, e, v) for s, k, e, v in sorted(found)]


class Automaton:
    """A probabilistic automaton: per state the count, the count of ends, how many symbols were still to come, and the counts
    and targets by symbol."""

    def __init__(self, words: Counter, alpha: float = ALPHA):
        self.total, self.ends, self.out, self.to, self.ahead = [0], [0], [{}], [{}], [{}]
        for word, n in sorted(words.items()):
            s = 0
            self.ahead[0][len(word)] = self.ahead[0].get(len(word), 0) + n
            for i, c in enumerate(word[:DEPTH], 1):
                self.total[s] += n
                self.out[s][c] = self.out[s].get(c, 0) + n
                if c not in self.to[s]:
                    self.total.append(0)
                    self.ends.append(0)
                    self.out.append({})
                    self.to.append({})
                    self.ahead.append({})
                    self.to[s][c] = len(self.total) - 1
                s = self.to[s][c]
                self.ahead[s][len(word) - i] = self.ahead[s].get(len(word) - i, 0) + n
            if len(word) <= DEPTH:
                self.total[s] += n
                self.ends[s] += n
        self.tree_states = len(self.total)
        self._merge(math.sqrt(0.5 * math.log(2 / alpha)))
        for word, n in sorted(words.items()):
            if len(word) > DEPTH:
                self._run_on(word, n)
        # The log2 shares and targets by state and symbol; a symbol not seen there has a small share and leads nowhere else.
        share = lambda n, s: math.log2((n + 0.01) / ((self.total[s] or 1) + 1))
        self.steps, self.other, self.stop, ways = {}, {}, {}, [0]
        while ways:
            s = ways.pop()
            if s not in self.steps:
                self.steps[s] = {c: (share(n, s), self.to[s].get(c, s)) for c, n in self.out[s].items()}
                self.other[s], self.stop[s] = (share(0, s), s), math.log2((self.ends[s] + 0.01) / (self.total[s] + 1))
                ways += self.to[s].values()
        del self.total, self.ends, self.out, self.to, self.ahead  # the prefix tree has done its work

    def _run_on(self, word: str, n: int) -> None:
        """Count the symbols past the tree in the merged states; one without a way on stays where it is."""
        s = 0
        for c in word[:DEPTH]:
            s = self.to[s][c]
        for c in word[DEPTH:]:
            self.total[s] += n
            self.out[s][c] = self.out[s].get(c, 0) + n
            s = self.to[s].setdefault(c, s)
        self.total[s] += n
        self.ends[s] += n

    def _differ(self, a: int, b: int, bound: float) -> bool:
        n, m = self.total[a], self.total[b]
        if not n or not m:  # the tree was cut there
            return False
        slack = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if abs(self.ends[a] / n - self.ends[b] / m) > slack:
            return True
        if any(abs(self.out[a].get(c, 0) / n - self.out[b].get(c, 0) / m) > slack for c in self.out[a].keys() | self.out[b].keys()):
            return True
        gap = 0.0  # between the shares of words with at most so many symbols to come
        for k in sorted(self.ahead[a].keys() | self.ahead[b].keys()):
            gap += self.ahead[a].get(k, 0) / n - self.ahead[b].get(k, 0) / m
            if abs(gap) > slack:
                return True
        return False

    def _compatible(self, a: int, b: int, bound: float) -> bool:
        pairs, seen = [(a, b)], set()
        while pairs:
            p, q = pairs.pop()
            if p == q or (p, q) in seen:
                continue
            seen.add((p, q))
            if self._differ(p, q, bound):
                return False
            pairs += [(self.to[p][c], self.to[q][c]) for c in self.to[p].keys() & self.to[q].keys()]
        return True

    def _fold(self, a: int, b: int) -> None:
        pairs = [(a, b)]
        while pairs:
            p, q = pairs.pop()
            self.total[p] += self.total[q]
            self.ends[p] += self.ends[q]
            for k, n in self.ahead[q].items():
                self.ahead[p][k] = self.ahead[p].get(k, 0) + n
            for c, n in self.out[q].items():
                self.out[p][c] = self.out[p].get(c, 0) + n
                if c in self.to[p]:
                    pairs.append((self.to[p][c], self.to[q][c]))
                else:
                    self.to[p][c] = self.to[q][c]

    def _merge(self, bound: float) -> None:
        """Take the frontier of the accepted states in order; fold each state into a compatible one or accept it."""
        accepted, queue = [0], [(0, c) for c in sorted(self.to[0])]
        while queue:
            p, c = queue.pop(0)
            b = self.to[p].get(c)
            if b is None or b in accepted:
                continue
            if not self.total[b]:
                self.to[p][c] = p
                continue
            home = next((a for a in accepted if self._compatible(a, b, bound)), None)
            if home is None:
                accepted.append(b)
                queue += [(b, x) for x in sorted(self.to[b])]
            else:
                self.to[p][c] = home
                self._fold(home, b)
                queue += [(a, x) for a in accepted for x in sorted(self.to[a]) if self.to[a][x] not in accepted and (a, x) not in queue]
        self.states = len(accepted)

    def score(self, word: str, least: float = -math.inf) -> float:
        """Mean log2 probability of a symbol, the end counted as one.

        Shares only lower a sum, so a score that can't reach ``least`` any more comes back as minus infinity at once.
        """
        s, bits, low = 0, 0.0, least * (len(word) + 1) - 1e-6
        for c in word:
            b, s = self.steps[s].get(c) or self.other[s]
            bits += b
            if bits < low:
                return -math.inf
        return (bits + self.stop[s]) / (len(word) + 1)


def class_bigrams(words: Counter) -> Counter:
    """Pairs of neighbouring classes, ``^`` before the first and ``$`` after the last."""
    pairs = Counter()
    for word, n in words.items():
        for pair, m in Counter(zip("^" + word, word + "$", strict=True)).items():
            pairs[pair] += n * m
    return pairs


class Grammar:
    """Automata by kind with their least and greatest accepted score, and the class bigrams of ordinary tokens."""

    def __init__(self, credentials: dict[str, Counter], ordinary: Counter, alpha: float = ALPHA, miss: float = MISS, bigrams: Counter | None = None):
        self.automata, self.bigrams = {}, Counter(bigrams or {})
        for kind, words in sorted(credentials.items()):
            automaton = Automaton(words, alpha)
            scores = sorted(s for w, n in words.items() for s in [automaton.score(w)] * n)
            cut = int(miss * len(scores))
            self.automata[kind] = (automaton, scores[cut], scores[-1 - cut])
        self.bigrams.update(class_bigrams(ordinary))
        self.firsts = Counter()
        for (a, _), n in self.bigrams.items():
            self.firsts[a] += n

    def background(self, word: str) -> float:
        return sum(math.log2((self.bigrams[p] + 0.5) / (self.firsts[p[0]] + 20)) for p in zip("^" + word, word + "$", strict=True)) / (len(word) + 1)

    def judge(self, word: str) -> tuple[bool, float | None]:
        """(does a format accept a token of these classes, its likelihood under the best automaton); no score without automata."""
        scores = [automaton.score(word) for automaton, _, _ in self.automata.values()]
        return self.fits(word), max(scores, default=None)

    def fits(self, word: str) -> bool:
        """Does a format accept a token of these classes?"""
        return any(least <= automaton.score(word, least) <= most and automaton.score(word) > self.background(word) for automaton, least, most in self.automata.values())

    def accepts(self, token: str) -> bool:
        """Is the token's format as likely as a labelled credential's, and likelier than an ordinary token's?"""
        return self.fits(symbols(token))

    def summary(self) -> dict[str, tuple[int, int]]:
        """States of the prefix tree and of the merged automaton by kind."""
        return {kind: (a.tree_states, a.states) for kind, (a, _, _) in self.automata.items()}


def _candidates(classes: str, covered: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, classes) of each candidate in a text of these classes that no covered span, sorted by start, touches."""
    every = ((m.start(), m.end(), m[0]) for m in _CANDIDATE.finditer(classes))
    return _outside(every, covered) if covered else every


def _outside(candidates: Iterator[tuple[int, int, str]], covered: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    i, reach = 0, 0  # the furthest end of the spans that start before the candidate's end
    for start, end, word in candidates:
        while i < len(covered) and covered[i][0] < end:
            reach, i = max(reach, covered[i][1]), i + 1
        if reach <= start:
            yield start, end, word


def infer_grammar(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Grammar:
    """Fit on about ``sample`` labelled values a kind, chosen by a hash of the value, and on all ordinary tokens.

    The background is summed by pair of classes, in each task first: about a hundred rows at any size.
    """

    def labelled(batches):
        from hashlib import blake2b

        ordinary, pairs, chars = Counter(), Counter(), 0
        for batch in batches:
            found = []
            for t in batch.column(0).to_pylist():
                t = t or ""
                classes = symbols(t)
                spans = base_matches(t)
                found += [(k, symbols(v), int.from_bytes(blake2b(v.encode(), digest_size=8).digest()) >> 11, 1) for k, _, _, v in spans]
                if spans:
                    ordinary.update(w for _, _, w in _candidates(classes, [(a, b) for _, a, b, _ in spans]))
                else:
                    ordinary.update(_CANDIDATE.findall(classes))
                chars += len(t)
                if chars > 32_000_000 or len(ordinary) > 200_000:
                    pairs.update(class_bigrams(ordinary))
                    ordinary.clear()
                    chars = 0
            yield pa.RecordBatch.from_pylist([dict(zip(_WORDS.names, x, strict=True)) for x in found], schema=_WORDS)
        pairs.update(class_bigrams(ordinary))
        yield pa.RecordBatch.from_pylist([{"kind": "pair", "word": "".join(p), "h": 0, "n": n} for p, n in pairs.items()], schema=_WORDS)

    words = written(docs.select(text_col).mapInArrow(labelled, "kind string, word string, h bigint, n bigint"), "labelled")
    bigrams = Counter({tuple(pair): n for pair, n in words.where("kind = 'pair'").groupBy("word").agg(F.sum("n")).collect()})  # a pair of 13 classes each
    words = words.where("kind <> 'pair'")
    held = {k: n for k, n in words.groupBy("kind").agg(F.count_distinct("h")).collect()}  # 3 kinds
    keep = F.lit(False)
    for k, n in held.items():
        keep = keep | ((F.col("kind") == k) & (F.col("h") < math.ceil((1 << 53) * min(1.0, sample / n))))
    found: dict[str, Counter] = {}
    for k, word, n in words.where(keep).groupBy("kind", "word").agg(F.count_distinct("h").alias("n")).collect() if held else []:
        found.setdefault(k, Counter())[word] += n
    return Grammar(found, Counter(), bigrams=bigrams)


def find_secrets(docs: DataFrame, text_col: str = "text", grammar: Grammar | None = None, out: str = "secrets", **options) -> DataFrame:
    """``docs`` with array ``out`` of spans (kind, start, end, score) by start, then kind; code points, end exclusive."""
    grammar = grammar or infer_grammar(docs, text_col, **options)

    @F.arrow_udf(_SPANS_TYPE)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        short = lru_cache(1 << 17)(grammar.fits)
        for text in texts:
            rows = []
            for t in text.to_pylist():
                t = t or ""
                classes = symbols(t)
                spans = [(s, KINDS.index(k), e, grammar.judge(symbols(v))[1]) for k, s, e, v in base_matches(t)]
                for s, e, word in _candidates(classes, [(s, e) for s, _, e, _ in spans]):
                    if (short if len(word) <= 64 else grammar.fits)(word):
                        spans.append((s, 3, e, grammar.judge(word)[1]))
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "score": score} for s, k, e, score in sorted(spans, key=lambda x: x[:3])])
            yield pa.array(rows, type=_SPANS)

    return docs.withColumn(out, scan(F.col(text_col)))


def redacted(docs: DataFrame, spans_col: str = "secrets", text_col: str = "text") -> DataFrame:
    """Texts with every found span replaced by ``[SECRET]``."""

    @F.arrow_udf("string")
    def cut(text: pa.Array, spans: pa.Array) -> pa.Array:
        rows = []
        for t, found in zip(text.to_pylist(), spans.to_pylist(), strict=True):
            if t is None or not found:
                rows.append(t)
                continue
            pieces, at = [], 0
            for s in found:
                if s["start"] >= at:
                    pieces += [t[at : s["start"]], "[SECRET]"]
                at = max(at, s["end"])
            rows.append("".join([*pieces, t[at:]]))
        return pa.array(rows, type=pa.string())

    return docs.withColumn(text_col, cut(F.col(text_col), F.col(spans_col)))
