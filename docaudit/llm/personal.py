"""Personal data: fixed formats, and identifiers found by the contexts that those formats' matches stand in."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm.common import documents, stored

# Fixed formats, in the order in which their spans are listed.
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does; runs give nothing back, so that time is linear in the text.
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Candidates beside the fixed formats: numbers of several digits, and strings around an @.
NUMBER = re.compile(r"(?<![0-9A-Za-z])[0-9](?:[\x20().:/-]{0,2}[0-9])*+(?![0-9A-Za-z])")
NUMBER_DIGITS = 6
TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
TRIM = ".,;:!?\"'()[]{}<>#$%&*=|"
MARKS = str.maketrans("", "", " ()-+")

PROMOTE = 0.8  # share of a kind among what a pattern surrounds, from which on it finds more of the kind
PRIOR = 3.0  # instances of the usual mixture that are added to each pattern's own, so that few prove nothing
UNKNOWN = 0.5  # weight of an instance that nothing is known of, against its being of any kind
ROUNDS = 4


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the address format, found from each @ backwards, so that long words without one cost nothing."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            free = m.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place, start, end) of the fixed formats, by kind, then start."""
    found = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        found += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return found


def around_at(text: str, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Strings without blanks around an @ in text[low:high], less the punctuation at their ends."""
    at, free = text.find("@", low, high), low
    while at >= 0:
        start, end = at, at + 1
        while start > free and TOKEN.match(text, start - 1, start):
            start -= 1
        m = TOKEN.match(text, end, high)
        end = free = m.end() if m else end
        while start < at and text[start] in TRIM:
            start += 1
        while end > at + 1 and text[end - 1] in TRIM:
            end -= 1
        if start < at and end > at + 1:
            yield start, end
        at = text.find("@", free, high)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, slot) of what may be an identifier beside the fixed formats' spans; the slot is "@" or "0"."""
    out, low = [], 0
    for a, b in [*sorted(s[1:] for s in spans), (len(text), len(text))]:
        if a > low:
            out += [(m.start(), m.end(), "0") for m in NUMBER.finditer(text, low, a) if m.end() - m.start() >= NUMBER_DIGITS and len(digits_of(m[0])) >= NUMBER_DIGITS]
            out += [(x, y, "@") for x, y in around_at(text, low, a)] if "@" in text else []
        low = max(low, b)
    kept: list[tuple[int, int, str]] = []
    for c in sorted(out, key=lambda c: (c[0], -c[1])):  # a number within a string around an @ is part of it
        if not kept or c[0] >= kept[-1][1]:
            kept.append(c)
    return kept


def word(s: str) -> str:
    """A context word: lower case, digits alike, without punctuation around it unless it is nothing else."""
    s = s.lower()
    return re.sub("[0-9]+", "0", s.strip(TRIM) or s)


def instance(value: str) -> int:
    return xxhash.xxh64_intdigest(value.lower().translate(MARKS)) - (1 << 63)


class Contexts:
    """The words of a text, for the patterns around its spans."""

    def __init__(self, text: str):
        self.text = text
        self.tokens = [m.span() for m in TOKEN.finditer(text)]
        self.starts = [a for a, _ in self.tokens]

    def patterns(self, start: int, end: int, slot: str) -> list[int]:
        """Hashes of: two words before, two words after, a word on either side; with what the slot holds."""
        i = bisect.bisect_right(self.starts, start) - 1  # the token in which the span begins
        j = bisect.bisect_left(self.starts, end)  # the first token that begins after it
        glued = self.text[self.tokens[i][0] : start]
        left = [word(glued)] if glued.strip(TRIM) else []
        for k in range(i - 1, max(i - 3, -1), -1):
            left.append(word(self.text[slice(*self.tokens[k])]))
        tail = self.text[end : self.tokens[j - 1][1]] if j else ""
        right = [word(tail)] if tail.strip(TRIM) else []
        for k in range(j, min(j + 2, len(self.tokens))):
            right.append(word(self.text[slice(*self.tokens[k])]))
        left, right = [*left, "^", "^"][:2], [*right, "$", "$"][:2]
        shapes = (("before", *left), ("after", *right), ("beside", left[0], right[0]))
        return [xxhash.xxh64_intdigest("\n".join((slot, *s))) - (1 << 63) for s in shapes]


NAMES = ["doc_id", "a", "b", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "seen"]
SEEN = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("known", pa.int32()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scanned(docs: DataFrame) -> DataFrame:
    """Per row: its base spans, and what it has of spans and candidates with their patterns. a, b: two hashes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, seen = [], []
            for t in b.column("text"):
                text = t.as_py() or ""
                base = base_spans(text)
                more = candidates(text, base)
                here = Contexts(text) if base or more else None
                spans = [(a, e, k, "0" if k else "@") for k, a, e in base] + [(a, e, -1, slot) for a, e, slot in more]
                seen.append([{"start": a, "stop": e, "known": k, "instance": instance(text[a:e]), "patterns": here.patterns(a, e, slot)} for a, e, k, slot in spans])
                kinds, whole = [s[0] for s in base], joined(base)
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(whole.encode()).hexdigest(), whole))
            types = [pa.int64()] * 4 + [pa.string()] * 2
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("a"), b.column("b"), *columns, pa.array(seen, SEEN)], names=NAMES)

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))
    schema = "doc_id long, a long, b long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, seen array<struct<start: int, stop: int, known: int, instance: long, patterns: array<long>>>"
    return rows.mapInArrow(run, schema)


def kind_sums(value: Column, kind: Column) -> list[Column]:
    return [F.sum(F.when(kind == k, value).otherwise(0.0)).alias(f"k{k}") for k in range(len(KINDS))]


def graph(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (pattern, instance, kind), each once however many texts have it, and the instances with their kinds.

    kind is that of a fixed format which the instance matches anywhere (the last in KINDS, if several), else -1.
    """
    each = seen.select("known", "instance", F.explode("patterns").alias("pattern"))
    edges = stored(each.groupBy("pattern", "instance").agg(F.max("known").alias("known")), "personal-edges")
    instances = stored(edges.groupBy("instance").agg(F.max("known").alias("kind")), "personal-instances")
    return stored(edges.drop("known").join(instances, "instance"), "personal-graph"), instances


def discovered(seen: DataFrame, rounds: int = ROUNDS, promote: float = PROMOTE) -> DataFrame:
    """(instance, kind, score) of the identifiers beside the fixed formats that trusted patterns surround.

    A pattern's confidence in a kind is that kind's share of the different instances it surrounds: seeds count
    1, unseen ones their score so far, what is left of UNKNOWN stands against; PRIOR instances of the usual mixture are
    added. A pattern of confidence ``promote`` or more is trusted. An unseen instance scores 1 - product of (1 - confidence)
    over its trusted patterns of the kind whose sum is largest. That is repeated ``rounds`` times, or until no further
    instance is found.
    """
    edges, instances = graph(seen)
    counts = {r["kind"]: r["count"] for r in instances.groupBy("kind").count().collect()}  # a row a kind
    total = max(sum(counts.values()), 1)
    prior = [PRIOR * counts.get(k, 0) / total for k in range(len(KINDS))]
    seeds = edges.groupBy("pattern").agg(*kind_sums(F.lit(1.0), F.col("kind")), F.sum(F.when(F.col("kind") < 0, UNKNOWN).otherwise(1.0)).alias("weight"))
    seeds = stored(seeds, "personal-seeds")
    unseen = edges.filter("kind < 0").select("pattern", "instance")
    found, before = None, -1
    for turn in range(rounds):
        scores = seeds
        if found is not None:
            gains = unseen.join(found, "instance").groupBy("pattern").agg(*kind_sums(F.col("score"), F.col("kind")), F.sum(F.greatest(F.col("score") - UNKNOWN, F.lit(0.0))).alias("weight"))
            gains = gains.select("pattern", *[F.col(c).alias(f"g_{c}") for c in gains.columns[1:]])
            scores = seeds.join(gains, "pattern", "left").select("pattern", *[(F.col(c) + F.coalesce(f"g_{c}", F.lit(0.0))).alias(c) for c in seeds.columns[1:]])
        sure = [(F.col(f"k{k}") + prior[k]) / (F.col("weight") + PRIOR) for k in range(len(KINDS))]
        best = F.array_max(F.array(*[F.struct(c.alias("sure"), F.lit(-k).alias("kind")) for k, c in enumerate(sure)]))  # ties: the first kind
        trusted = scores.select("pattern", best.alias("best")).select("pattern", F.col("best.sure").alias("sure"), (-F.col("best.kind")).alias("kind")).filter(F.col("sure") >= promote)
        each = unseen.join(trusted, "pattern").groupBy("instance", "kind").agg(F.sum(-F.log1p(-F.least("sure", F.lit(0.999999)))).alias("evidence"))
        top = F.max(F.struct("evidence", (-F.col("kind")).alias("kind"))).alias("top")
        found = each.groupBy("instance").agg(top).select("instance", (-F.col("top.kind")).alias("kind"), (1 - F.exp(-F.col("top.evidence"))).alias("score"))
        found = stored(found, f"personal-found-{turn}")
        now = found.count()
        if now == before:
            break
        before = now
    return found


def find_personal(docs: DataFrame, rounds: int = ROUNDS, promote: float = PROMOTE) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found.

    Spans are kind:start:end in code points, comma-joined by kind, then start. The fixed formats come as they are; further
    identifiers, found through the contexts they share with those (see ``discovered``), follow as kinds of their own, "found_"
    and the kind, and overlap none of them. A null or empty text has none. Repeated rows each have
    their spans, but count once as evidence, as do copies of a context; null ids and other columns make no difference.
    Every text is read once; what it has of contexts is kept, so the rounds work on a few numbers an occurrence.
    """
    rows = stored(scanned(docs), "personal-rows")
    texts = rows.filter(F.size("seen") > 0).dropDuplicates(["a", "b"])
    seen = stored(texts.select("a", "b", F.explode("seen").alias("s")).select("a", "b", "s.*"), "personal-seen")
    found = discovered(seen, rounds, promote)
    spans = seen.filter("known < 0").join(found, "instance").select("a", "b", "kind", "start", "stop")
    more = spans.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "stop"))).alias("more"))
    more = more.select("a", "b", F.transform("more", lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(f"found_{k}") for k in KINDS]), s["kind"] + 1), s["start"], s["stop"])).alias("more"))
    out = rows.drop("seen").join(more, ["a", "b"], "left")
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.array_join("more", ","))
    return out.select(*NAMES[:1], *NAMES[3:8], both.alias("spans"), F.when(F.col("more").isNull(), 0).otherwise(F.size("more")).cast("long").alias("n_found"))


def op12_personal(spark: SparkSession, sf: str) -> DataFrame:
    return find_personal(documents(spark, sf))
