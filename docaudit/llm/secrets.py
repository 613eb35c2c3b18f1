"""Secret scans: fixed formats, and formats learned from them as probabilistic automata."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import documents, stored

# Fixed formats, in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SAMPLE = 400  # labelled credentials of a kind, and ordinary strings, that training takes
LONGEST = 128  # characters of a labelled string
MARGIN = 0.5  # nats a character by which a format must beat the ordinary model


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, value) of the fixed formats, by start, then kind."""
    found = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):  # no match is possible without one of them
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: Iterable[tuple]) -> Iterator[tuple[int, int, str]]:
    """Long strings of credential characters that touch no span."""
    spans = [(s[0], s[2]) for s in spans]
    for m in CANDIDATE.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in spans):
            yield m.start(), m.end(), m[0]


# The automata see classes of characters; within a class all characters are alike.
CLASSES = {c: k for k, cs in {"9": "0123456789", "a": "abcdef", "g": "ghijklmnopqrstuvwxyz", "A": "ABCDEF", "G": "GHIJKLMNOPQRSTUVWXYZ"}.items() for c in cs} | {c: c for c in "+/_.=-"}
SPREAD = {k: math.log(sum(v == k for v in CLASSES.values())) for k in set(CLASSES.values())}


def classes(value: str) -> str:
    return "".join(CLASSES[c] for c in value)


class Automaton:
    """A probabilistic automaton: a prefix tree whose statistically compatible states are merged.

    Two states are compatible if the shares with which they stop, and follow each symbol, differ by
    less than their Hoeffding bounds, and so do all states that both reach. States are visited
    in breadth-first order; one that fits none of those kept so far is kept itself.
    """

    def __init__(self, strings: Iterable[str], alpha: float = 0.05):
        self.visits, self.stops, self.next = [0], [0], [{}]
        for s in strings:
            at = 0
            for c in s:
                self.visits[at] += 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.visits)
                    self.visits.append(0)
                    self.stops.append(0)
                    self.next.append({})
                at = self.next[at][c]
            self.visits[at] += 1
            self.stops[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self.flow = [{c: self.visits[t] for c, t in n.items()} for n in self.next]
        self._merge()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) >= self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.visits[a], self.visits[b]
            if self._differ(self.stops[a], n, self.stops[b], m):
                return False
            for c in self.next[a].keys() | self.next[b].keys():
                if self._differ(self.flow[a].get(c, 0), n, self.flow[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.stops[a] += self.stops[b]
            for c, t in self.next[b].items():
                self.flow[a][c] = self.flow[a].get(c, 0) + self.flow[b][c]
                if c in self.next[a]:
                    todo.append((self.next[a][c], t))
                else:
                    self.next[a][c] = t

    def _merge(self) -> None:
        kept = [0]
        while True:
            edges = [(a, c, t) for a in kept for c, t in sorted(self.next[a].items()) if t not in kept]
            if not edges:
                return
            a, c, t = edges[0]
            for r in kept:
                if self._compatible(r, t):
                    self.next[a][c] = r
                    self._fold(r, t)
                    break
            else:
                kept.append(t)

    def score(self, s: str) -> float:
        """Log-likelihood of a class string; minus infinity if the format has no such string."""
        at, total = 0, 0.0
        for c in s:
            if c not in self.next[at]:
                return -math.inf
            total += math.log(self.flow[at][c] / self.visits[at]) - SPREAD[c]
            at = self.next[at][c]
        return total + (math.log(self.stops[at] / self.visits[at]) if self.stops[at] else -math.inf)


class Ordinary:
    """First-order model of the classes in ordinary strings, every step possible."""

    def __init__(self, strings: Iterable[str]):
        self.steps: dict[str, dict[str, int]] = {}
        for s in strings:
            for a, b in zip("^" + s, s + "$", strict=True):
                row = self.steps.setdefault(a, {})
                row[b] = row.get(b, 0) + 1

    def score(self, s: str) -> float:
        total = 0.0
        for a, b in zip("^" + s, s + "$", strict=True):
            row = self.steps.get(a, {})
            total += math.log((row.get(b, 0) + 1) / (sum(row.values()) + len(SPREAD) + 1)) - SPREAD.get(b, 0.0)
        return total


def labelled_strings(docs: DataFrame, sample: int = SAMPLE) -> dict[str, list[str]]:
    """Per kind, the ``sample`` distinct credentials of the fixed formats with the least hashes; as "plain", other candidates.

    Every text is searched. A task passes on the ``sample`` least of a kind, which hold the least of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[str, list] = {k: [] for k in (*KINDS, "plain")}
        held: dict[str, set] = {k: set() for k in heaps}

        def offer(kind: str, value: str) -> None:
            if len(value) > LONGEST or value in held[kind]:
                return
            entry = (-xxhash.xxh64_intdigest(value), value)
            if len(heaps[kind]) < sample:
                heapq.heappush(heaps[kind], entry)
            elif entry > heaps[kind][0]:
                held[kind].discard(heapq.heapreplace(heaps[kind], entry)[1])
            else:
                return
            held[kind].add(value)

        for b in batches:
            for t in b.column("text"):
                text = t.as_py() or ""
                spans = base_spans(text)
                for _, kind, _, value in spans:
                    offer(KINDS[kind], value)
                for _, _, value in candidates(text, spans):
                    offer("plain", value)
        rows = [(k, v) for k, h in heaps.items() for _, v in h]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], names=["kind", "value"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "kind string, value string").distinct()
    found = stored(found, "secret-strings")
    out: dict[str, list[str]] = {}
    for kind in (*KINDS, "plain"):
        least = found.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(sample)
        out[kind] = [r["value"] for r in least.select("value").collect()]  # ``sample`` short strings at most
    return out


class Formats:
    """The learned formats: an automaton per kind of credential against the ordinary model."""

    def __init__(self, strings: dict[str, list[str]], margin: float = MARGIN):
        self.automata = {k: Automaton(map(classes, v)) for k, v in strings.items() if k != "plain" and v}
        self.ordinary = Ordinary(map(classes, strings.get("plain", [])))
        self.margin = margin

    def is_secret(self, value: str) -> bool:
        s = classes(value)
        best = max((a.score(s) for a in self.automata.values()), default=-math.inf)
        return best - self.ordinary.score(s) > self.margin * len(s)


def all_spans(text: str, formats: Formats) -> tuple[list[tuple], list[tuple]]:
    """The fixed formats' spans, and all spans with the learned ones, each by start."""
    base = base_spans(text)
    learned = [(a, len(KINDS), b, v) for a, b, v in candidates(text, base) if formats.is_secret(v)]
    return base, sorted(base + learned)


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{(*KINDS, 'learned')[k]}:{a}:{b}" for a, k, b, _ in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_learned.

    Spans are kind:start:end in code points, comma-joined by start; the fixed formats come as they
    are, the automata add spans of kind "learned". A null or blank text has none (the digest
    is that of the empty string). Repeated rows, null ids and other columns make no difference.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Formats(labelled_strings(docs)))  # bounded by SAMPLE * LONGEST states
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_learned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text"):
                base, spans = all_spans(t.as_py() or "", shared.value)
                kinds = [s[1] for s in spans]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(3)), digest, joined(spans), kinds.count(3)))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=names)

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_learned long"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The documents with each secret replaced by ``mark``; all other rows and columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(Formats(labelled_strings(docs)))

    def clean(text: str) -> str:
        out, at = [], 0
        for a, _, b, _ in all_spans(text, shared.value)[1]:
            if b > at:
                out += [text[at:a], mark] if a >= at else []
                at = b
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([None if (v := t.as_py()) is None else clean(v) for t in b.column("text")], pa.string())
            yield b.set_column(b.schema.get_field_index("text"), "text", texts)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op9_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return find_secrets(documents(spark, sf))
