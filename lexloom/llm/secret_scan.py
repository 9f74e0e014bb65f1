"""Secret scans: probabilistic automata inferred from labelled credentials."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.common import shared_table
from lexloom.session import ship_package

#: The base detectors in the order in which kinds are listed, with the least length of what they find.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN = 6
#: Candidates: tokens as long as the shortest credential that the base detectors know.
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_.=-]{{{MIN_ASSIGN},}}")
SYMBOLS = 67
LEARNED = "format"
END = ""

#: Bounds on the labelled credentials of each kind, and on the ordinary tokens of each shape, that the automata are fitted to.
SAMPLE = 600
ORDINARY = 1_000
ROUNDS = 3
ALPHA = 0.05
#: A token is reported if it is this many times likelier a credential than not, given how rare credentials are among the corpus's tokens.
ODDS = 20
#: Nats by which a shape's own automaton must explain a sampled token better than the credential formats do, for it to count as ordinary.
CLEAR = 5.0
#: Scores that a worker remembers; then it starts over.
REMEMBERED = 200_000


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base detectors, sorted by start, then kind as listed; code points, end exclusive.

    A run of hex digits or an access key is maximal, so asking for the least length finds what dropping shorter ones would.
    """
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, taken: list[tuple]) -> Iterator[tuple[int, int, str]]:
    """(start, end, token) of the tokens outside the base spans; a token that a span cuts gives its pieces.  One pass over both sorted lists."""
    at, i = 0, 0
    for m in CANDIDATE.finditer(text):
        a, end = m.span()
        while i < len(taken) and taken[i][0] < end:
            s, _, e, _ = taken[i]
            if s - max(a, at) >= MIN_ASSIGN:
                yield max(a, at), s, text[max(a, at) : s]
            at, i = max(at, e), i + 1
        a = max(a, at)
        if end - a >= MIN_ASSIGN:
            yield a, end, text[a:end]


class Automaton:
    """Deterministic probabilistic automaton from a prefix tree whose compatible states are merged.

    States are tried in breadth-first order against those already kept; two are compatible if the frequencies of
    ending, of each next character and of each class of characters, there and at all their successors, differ by less than a Hoeffding bound.
    """

    def __init__(self, words: Iterable[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.total = [0]
        for w in words:
            at = 0
            self.total[0] += 1
            for c in w:
                self.flow[at][c] = self.flow[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.flow.append({})
                    self.ends.append(0)
                    self.total.append(0)
                at = self.next[at][c]
                self.total[at] += 1
            self.ends[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return n and m and abs(x / n - y / m) > self.bound * (n**-0.5 + m**-0.5)

    def _by_class(self, state: int) -> dict[str, int]:
        out: dict[str, int] = {}
        for c, n in self.flow[state].items():
            k = "digit" if c.isdigit() else "lower" if c.islower() else "upper" if c.isupper() else c
            out[k] = out.get(k, 0) + n
        return out

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.total[a], self.total[b]
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            one, two = self._by_class(a), self._by_class(b)
            if any(self._differ(one.get(k, 0), n, two.get(k, 0), m) for k in one.keys() | two.keys()):
                return False
            for c in self.flow[a].keys() | self.flow[b].keys():
                if self._differ(self.flow[a].get(c, 0), n, self.flow[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for c, n in self.flow[b].items():
                self.flow[a][c] = self.flow[a].get(c, 0) + n
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge(self) -> None:
        kept, fresh = [0], [(0, c) for c in sorted(self.next[0])]
        known = {0}
        while fresh:
            parent, c = fresh.pop(0)
            blue = self.next[parent][c]
            if blue in known:
                continue
            for red in kept:
                if self._compatible(red, blue):
                    self.next[parent][c] = red
                    self._fold(red, blue)
                    break
            else:
                kept.append(blue)
                known.add(blue)
            fresh = [(p, c) for p in kept for c in sorted(self.next[p]) if self.next[p][c] not in known]
        number = {s: i for i, s in enumerate(kept)}
        usual, everything = Counter(), 0
        for s in kept:
            usual.update(self.flow[s])
            usual[END] += self.ends[s]
            everything += self.total[s]
        self.rare = -math.log(everything + SYMBOLS + 1)
        usual = {c: math.log(n + 1) + self.rare for c, n in usual.items()}
        self.table, self.miss, self.usual = [], [], usual
        for s in kept:
            ways = {**self.flow[s], **({END: self.ends[s]} if self.ends[s] else {})}
            whole = self.total[s] + len(ways)
            self.table.append({c: (math.log((n + len(ways) * math.exp(usual[c])) / whole), number[self.next[s][c]] if c else 0) for c, n in ways.items()})
            self.miss.append(math.log(max(1, len(ways)) / max(1, whole)))
        del self.next, self.flow, self.ends, self.total

    def score(self, word: str) -> float:
        """Log-likelihood of the word with its end.  A state without a step for a character falls back to the character's share of all steps (as much
        as the state has met new characters), and goes on from where the first state leads with it."""
        at, total = 0, 0.0
        table, miss, usual, rare = self.table, self.miss, self.usual, self.rare
        for c in (*word, END):
            step = table[at].get(c)
            if step is None:
                total += miss[at] + usual.get(c, rare)
                at = table[0].get(c, (0, 0))[1]
            else:
                total, at = total + step[0], step[1]
        return total


def shape(token: str) -> int:
    """Which of lower case, upper case, digits and symbols a token has, as bits."""
    return (token != token.upper()) + 2 * (token != token.lower()) + 4 * (_DIGIT.search(token) is not None) + 8 * (not token.isalnum())


_DIGIT = re.compile("[0-9]")


class Smallest:
    """The ``k`` smallest of many (key, value) pairs."""

    def __init__(self, k: int):
        self.k, self.kept, self.bound = k, [], math.inf

    def add(self, key: int, value: str) -> None:
        if key < self.bound:
            self.kept.append((key, value))
            if len(self.kept) >= 2 * self.k:
                self.cut()

    def cut(self) -> list[tuple[int, str]]:
        self.kept.sort()
        del self.kept[self.k :]
        if len(self.kept) == self.k:
            self.bound = self.kept[-1][0]
        return self.kept


class Format:
    """The automata of a kind of credential: one for each shape that its values have, with the share of that shape, and one for all other shapes."""

    def __init__(self, words: list[str]):
        by: dict[int, list[str]] = {}
        for w in words:
            by.setdefault(shape(w), []).append(w)
        self.any, self.rare = Automaton(words), -math.log(len(words) + 16)
        self.shapes = {k: (math.log((len(v) + 1) / (len(words) + 16)), Automaton(v)) for k, v in sorted(by.items())}

    def score(self, word: str, k: int) -> float:
        share, automaton = self.shapes.get(k, (self.rare, self.any))
        return share + automaton.score(word)


class Model:
    """A :class:`Format` for each kind of credential, and an automaton for the ordinary tokens of each shape.

    ``ordinary`` has, for each shape, the number of the corpus's tokens and a sample of them; ``n_credentials`` is the number of labelled credentials.
    Credentials that no detector labels are among the tokens of their shape: those that the shape's own automaton does not explain clearly better than
    a credential automaton does leave the sample, and the shape's automaton is inferred again from the rest.
    """

    def __init__(self, credentials: dict[str, list[str]], ordinary: dict[int, tuple[int, list[str]]], n_credentials: int):
        self.kinds = {k: Format(v) for k, v in sorted(credentials.items()) if v}
        n_tokens = max(1, sum(n for n, _ in ordinary.values()))
        self.threshold = math.log(ODDS) + math.log(n_tokens / max(1, n_credentials))
        self.shapes, self.shares = {}, {}
        for k, (n, words) in sorted(ordinary.items()):
            rest, own = words, Automaton(words)
            for _ in range(ROUNDS):
                left = [w for w in words if self.format(w, k) + CLEAR < own.score(w)]
                if len(left) == len(rest):
                    break
                rest, own = left, Automaton(left)
            self.shapes[k], self.shares[k] = own, math.log((n * len(rest) / len(words) + 1) / (n_tokens + 16))
        self.unseen, self.none = -math.log(n_tokens + 16), Automaton([])
        self._known: dict[str, bool] = {}

    def format(self, word: str, k: int) -> float:
        """Log-likelihood of a word of shape ``k`` under the best credential format; -inf without credentials."""
        return max((a.score(word, k) for a in self.kinds.values()), default=-math.inf)

    def score(self, word: str) -> float:
        """By how many nats the best credential format explains the word better than ordinary text."""
        k = shape(word)
        return self.format(word, k) - self.shares.get(k, self.unseen) - self.shapes.get(k, self.none).score(word)

    def credential(self, word: str) -> bool:
        known = self._known.get(word)
        if known is None:
            if len(self._known) >= REMEMBERED:
                self._known.clear()
            known = self._known[word] = self.score(word) > self.threshold
        return known


def survey(docs: DataFrame, ordinary: int = ORDINARY) -> DataFrame:
    """(kind, shape, value, key, n): credentials by value (kinds of KINDS), a sample of the tokens of each shape (kind sample) and their number (kind tokens).

    A token's key is a hash of it and of its row's id; each batch gives the ``ordinary`` smallest keys of a shape, so those of all rows are among them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        shapes: dict[str, int] = {}
        for b in batches:
            found, many, keep = Counter(), Counter(), {}
            for doc, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = x.as_py() or ""
                spans = base_spans(text)
                found.update((KINDS[k], v) for _, k, _, v in spans)
                seed = digest(str(doc))
                for w, n in Counter(w for _, _, w in candidates(text, spans)).items():
                    if (k := shapes.get(w)) is None:
                        if len(shapes) >= REMEMBERED:
                            shapes.clear()
                        k = shapes[w] = shape(w)
                    many[k] += n
                    keep.setdefault(k, Smallest(ordinary)).add(digest(w, seed) >> 1, w)
            rows = [*((kind, 0, v, 0, c) for (kind, v), c in found.items()), *(("sample", k, w, h, 1) for k, s in keep.items() for h, w in s.cut()), *(("tokens", k, None, 0, n) for k, n in many.items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                                                 ["kind", "shape", "value", "key", "n"])

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "kind string, shape int, value string, key long, n long")


def fit(docs: DataFrame, sample: int = SAMPLE, ordinary: int = ORDINARY) -> Model:
    """Automata from at most ``sample`` labelled credentials of each kind (those with the smallest hashes), labelled by the
    detector that found them, and ``ordinary`` tokens of each shape.  The bounds keep the fit small; counts are of all rows, and every token is scored."""
    rows = shared_table(survey(docs, ordinary).groupBy("kind", "shape", "value", "key").agg(F.sum("n").alias("n")), "secret-survey")
    total = {(r[0], r[1]): r[2] for r in rows.where("kind <> 'sample'").groupBy("kind", "shape").agg(F.sum("n")).collect()}
    order = F.md5(F.concat_ws(":", "kind", "value"))
    credentials = {k: [r[0] for r in rows.where(F.col("kind") == k).orderBy(order).limit(sample).select("value").collect()] for k in KINDS if (k, 0) in total}
    place = F.row_number().over(Window.partitionBy("shape").orderBy("key", "value"))
    words: dict[int, list[str]] = {}
    for r in rows.where("kind = 'sample'").withColumn("place", place).where(F.col("place") <= ordinary).orderBy("shape", "place").collect():
        words.setdefault(r["shape"], []).append(r["value"])
    return Model(credentials, {k: (total["tokens", k], w) for k, w in words.items()}, sum(total.get((k, 0), 0) for k in KINDS))


def find(text: str, model: Model) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans of a text, base and learned, sorted by start, then kind as listed."""
    base = base_spans(text)
    out = [(s, k, e) for s, k, e, _ in base] + [(s, len(KINDS), e) for s, e, w in candidates(text, base) if model.credential(w)]
    return [(s, (*KINDS, LEARNED)[k], e) for s, k, e in sorted(out)]


def scan(docs: DataFrame, sample: int = SAMPLE, ordinary: int = ORDINARY) -> DataFrame:
    """Secrets in every row's whole text.

    The base detectors' hits are labelled credentials; automata inferred from a bounded sample of them, and one inferred from ordinary tokens, score
    every other token of ``MIN_ASSIGN`` characters or more of every text.  One is reported, as kind ``format``, if its credential likelihood is
    ``ODDS`` times what its ordinary one and the rarity of credentials in the corpus ask for; short tokens need as much evidence as
    long ones.  Null and empty texts have no spans; repeated rows are scanned alike; an empty table gives no rows (and no
    automata); without labelled credentials there are no learned spans; further columns are ignored.

    Returns doc_id, n_assign, n_access, n_hex, base_sha256 (of base spans, kind:start:end, comma-joined) and spans.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, sample, ordinary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            counts, digests, spans = {k: [] for k in KINDS}, [], []
            for x in b.column(1):
                got = find(x.as_py() or "", m)
                base = [x for x in got if x[1] != LEARNED]
                for k in KINDS:
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(got))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                                             ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)
