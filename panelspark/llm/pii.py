"""Personal data: identifiers by their form, and further ones by bootstrapped contexts.

Forms give seed entities. The two words before a seed are a lexical pattern; patterns that enough distinct seeds share
are followed through the whole corpus. Spark scores the graph of patterns and the instances that follow them: a
pattern is as good as the share of its followers that are known or believed, an instance as believable as its patterns
together. Patterns that end above the threshold find identifiers whose form the seeds don't cover.

Patterns are a Spark table, however many there are. Tasks get a bitmap of fixed size over the patterns' hashes, and what passes
it is joined with the table, so a chance hit in the bitmap costs a row and changes nothing.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import _power_tables, blocks, mix, store

KINDS = ("email", "ip", "card", "phone")
#: Distinct seeds that a pattern needs.
LEAST_SEEDS = 3
#: Bits of the bitmap that travels to the tasks, and of one row of it.
FILTER_BITS, FILTER_ROW = 1 << 26, 1 << 15
ROUNDS = 3
CONFIDENCE = 0.6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Every address and card lies inside one such run, which keeps the searches linear on long digit runs.
_DIGIT_RUN = re.compile(r"[0-9][0-9.\x20-]*")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_FOLLOWER = {"email": re.compile(r"[^\s@]+@[^\s@]*[^\s@.,;:!?]")} | dict.fromkeys(("ip", "card", "phone"), re.compile(r"\+?[(0-9][0-9().\x20-]{3,}[0-9]"))
_LETTERS = re.compile(r"[^\W\d_]+")
_BLANKS = re.compile(r"[^\S\n]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start: leftmost non-overlapping matches of each kind's form that pass its test."""
    out = []
    at, taken = text.find("@"), 0
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            taken = domain.end()
            out.append(("email", start, taken))
        at = text.find("@", max(at + 1, taken))
    ips, cards = [], []
    for run in _DIGIT_RUN.finditer(text):
        a, b = run.span()
        if b - a < 7:
            continue
        ips += [("ip", m.start(), m.end()) for m in _IP.finditer(text, a, b) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.groups())]
        for m in _CARD.finditer(text, a, b):
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                cards.append(("card", m.start(), m.end()))
    phones = [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out + ips + cards + phones


def _instance(kind: str, text: str) -> str:
    return text.lower() if kind == "email" else _digits(text)


def _context(text: str, start: int) -> str | None:
    """The two words before a place of the same line, with up to three other characters in between, or None. Words are whole."""
    end = start
    while start - end < 3 and end and not (text[end - 1].isalnum() or text[end - 1] in "_\n"):
        end -= 1
    if end == start < len(text) and _LETTERS.match(text, start):
        return None
    words = []
    for blank in (False, True):
        place = end
        while blank and place and text[place - 1].isspace() and text[place - 1] != "\n":
            place -= 1
        if blank and place == end:
            return None
        end = place
        while place and text[place - 1].isalnum() and not text[place - 1].isdecimal():
            place -= 1
        if place == end:
            return None
        words.append(text[place:end])
        end = place
    return f"{words[1]} {words[0]}"


_tables: list[np.ndarray] = []


def _character_tables() -> list[np.ndarray]:
    """For every code point: whether it is a letter, whether a blank, and its lower case (equal for all that ``lower`` makes equal)."""
    if not _tables:
        every = "".join(map(chr, range(0x110000)))
        letter, blank, low = np.zeros(len(every), bool), np.zeros(len(every), bool), np.arange(len(every), dtype=np.uint32)
        for form, table in ((_LETTERS, letter), (_BLANKS, blank)):
            for m in form.finditer(every):
                table[m.start():m.end()] = True
        low[letter] = [ord(chr(c).lower()[0]) for c in np.flatnonzero(letter)]
        low[ord("\u03c2")] = ord("\u03c3")  # a capital sigma becomes either
        _tables.extend((letter, blank, low))
    return _tables


def _pairs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all pairs of words with only blanks of one line between: the text's number, the place of the pair's end, the pair's hash."""
    letter, blank, low = _character_tables()
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.diff(letter[points].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    other = np.concatenate([[0], np.cumsum(~blank[points], dtype=np.int32)])
    powers, inverse = _power_tables(len(points))
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(low[points].astype(np.uint64) + np.uint64(1)) * powers[:len(points)], out=sums[1:])
    h = mix((sums[ends] - sums[starts]) * inverse[starts])
    at = np.flatnonzero(other[starts[1:]] == other[ends[:-1]])
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
    row = np.searchsorted(first, ends[at + 1], "right") - 1
    return row, ends[at + 1] - first[row], mix(h[at] * np.uint64(31) + h[at + 1])


def _bit(pairs: np.ndarray, kind: str) -> np.ndarray:
    return (mix(pairs + np.uint64(KINDS.index(kind) + 1)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for block in blocks(batches):
        yield block, [t or "" for t in block.column("text").to_pylist()]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, texts in _texts(batches):
        found = {(kind, context, _instance(kind, text[a:b])) for text in texts for kind, a, b in base_spans(text) if (context := _context(text, a))}
        found = sorted(found)
        pairs = _pairs([context for _, context, _ in found])[2]
        bits = {kind: _bit(pairs, kind).tolist() for kind in KINDS}
        rows = list({(kind, context.lower(), bits[kind][i], instance) for i, (kind, context, instance) in enumerate(found)})
        types = {"kind": pa.string(), "pattern": pa.string(), "bit": pa.int64(), "instance": pa.string()}
        yield pa.RecordBatch.from_pydict({name: pa.array([r[i] for r in rows], t) for i, (name, t) in enumerate(types.items())})


def induce_patterns(docs: DataFrame) -> DataFrame:
    """``kind, pattern, bit`` of all patterns with at least ``LEAST_SEEDS`` distinct seeds."""
    seeds = docs.select("text").mapInArrow(_seeds, "kind string, pattern string, bit long, instance string").distinct()
    counts = seeds.groupBy("kind", "pattern", "bit").agg(F.count(F.lit(1)).alias("n"))
    return store(counts.where(F.col("n") >= LEAST_SEEDS).drop("n"), "seed-patterns")


def _bitmap(patterns: DataFrame) -> bytes:
    """The patterns' bits, ``FILTER_BITS`` in all whatever the number of patterns (packed); empty without patterns."""
    rows = patterns.groupBy(F.expr(f"bit div {FILTER_ROW}").alias("row")).agg(F.bitmap_construct_agg(F.expr(f"bit % {FILTER_ROW}")).alias("bits")).collect()
    bits = bytearray(FILTER_BITS // 8 if rows else 0)
    for r in rows:
        bits[r["row"] * (FILTER_ROW // 8):(r["row"] + 1) * (FILTER_ROW // 8)] = r["bits"]
    return zlib.compress(bytes(bits), 1)


class _Finder:
    """Places in texts that may follow a pattern, by the hashes of all pairs of words of a block."""

    def __init__(self, bitmap: bytes):
        self.bits = np.frombuffer(zlib.decompress(bitmap), np.uint8)

    def ends(self, texts: list[str]) -> dict[int, list[tuple[str, int]]]:
        """By text, the kinds and the ends of the pairs of words that may be patterns of them."""
        out: dict[int, list[tuple[str, int]]] = {}
        if len(self.bits):
            row, end, pairs = _pairs(texts)
            for kind in KINDS:
                bit = _bit(pairs, kind)
                at = np.flatnonzero(self.bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                for r, e in zip(row[at].tolist(), end[at].tolist()):
                    out.setdefault(r, []).append((kind, e))
        return out


def _follower(kind: str, text: str, end: int, base: dict[tuple[str, int], int]) -> tuple[int, int, bool] | None:
    """What follows a pair of words at any place of which the pair is the context: start, end and whether it is a seed (seeds first)."""
    last = end
    while last - end < 3 and last < len(text) and not (text[last].isalnum() or text[last] in "_\n"):
        last += 1
    for place in range(end, last + 1):
        if (kind, place) in base:
            return place, base[kind, place], True
    for place in range(end, last + 1):
        like = _FOLLOWER[kind].match(text, place)
        if like and (kind != "email" or text[place] in _LOCAL or text[place].isalnum()):
            return place, like.end(), False
    return None


def _followed(bitmap: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(bitmap)
        for _, texts in _texts(batches):
            seen: dict[tuple, int] = {}
            for r, ends in finder.ends(texts).items():
                base = {(k, a): b for k, a, b in base_spans(texts[r])}
                for kind, end in ends:
                    what = _follower(kind, texts[r], end, base)
                    key = (kind, _context(texts[r], end).lower(), _instance(kind, texts[r][what[0]:what[1]]) if what else None, bool(what and what[2]))
                    seen[key] = seen.get(key, 0) + 1
            columns = {name: pa.array([k[i] for k in seen], t) for i, (name, t) in enumerate((("kind", pa.string()), ("pattern", pa.string()), ("instance", pa.string()), ("seed", pa.bool_())))}
            yield pa.RecordBatch.from_pydict(columns | {"n": pa.array(list(seen.values()), pa.int64())})
    return run


def score_patterns(docs: DataFrame, patterns: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``kind, pattern, confidence`` after ``rounds`` of scoring the pattern-instance graph.

    Followers that can be no identifier count in a pattern's total and are believed never, seeds always.
    """
    edges = docs.select("text").mapInArrow(_followed(_bitmap(patterns)), "kind string, pattern string, instance string, seed boolean, n long")
    edges = edges.groupBy("kind", "pattern", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))
    edges = store(edges.join(patterns, ["kind", "pattern"], "left_semi"), "pattern-graph")
    totals = edges.groupBy("kind", "pattern").agg(F.sum("n").alias("total"))
    links = edges.where("instance is not null")
    belief = F.when(F.col("seed"), 1.0).otherwise(0.0)
    for _ in range(rounds):
        held = links.withColumn("belief", belief).groupBy("kind", "pattern").agg(F.sum(F.col("n") * F.col("belief")).alias("held"))
        scores = totals.join(held, ["kind", "pattern"], "left").select("kind", "pattern", (F.coalesce("held", F.lit(0.0)) / F.col("total")).alias("confidence"))
        scores = store(scores, "pattern-scores")
        doubt = edges.where("instance is not null").join(scores, ["kind", "pattern"]).groupBy("kind", "instance").agg(
            F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))).alias("doubt"))
        links = edges.where("instance is not null").join(doubt, ["kind", "instance"])
        belief = F.when(F.col("seed"), 1.0).otherwise(1 - F.exp("doubt"))
    return scores


Spans = list[tuple[str, int, int, bool]]


class _Taken:
    """The stretches of a text that base spans hold, by start with the furthest end so far, and disjoint ones added later."""

    def __init__(self, base: list[tuple[str, int, int]]) -> None:
        spans = sorted((a, b) for _, a, b in base)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))
        self.added: list[tuple[int, int]] = []

    def free(self, start: int, end: int) -> bool:
        """Whether the stretch meets no base span and none added; a search in each of the two lists."""
        before = bisect_left(self.starts, end)
        if before and self.ends[before - 1] > start:
            return False
        before = bisect_left(self.added, (end, end))
        return not before or self.added[before - 1][1] <= start

    def add(self, start: int, end: int) -> None:
        insort(self.added, (start, end))


def _candidates(text: str, ends: list[tuple[str, int]], base: list[tuple[str, int, int]]) -> list[dict]:
    """What follows the pairs of words and overlaps no base span."""
    starts, taken, out = {(k, a): b for k, a, b in base}, _Taken(base), []
    for kind, end in ends:
        what = _follower(kind, text, end, starts)
        if what and (kind == "email" or len(_digits(text[what[0]:what[1]])) >= 5) and taken.free(what[0], what[1]):
            out.append({"kind": kind, "pattern": _context(text, end).lower(), "start": what[0], "end": what[1]})
    return out


def _settled(base: list[tuple[str, int, int]], more: list[dict]) -> Spans:
    """Base spans and, by patterns (best first), those of ``more`` that overlap no span yet."""
    own, taken = [(k, a, b, True) for k, a, b in base], _Taken(base)
    for m in sorted(more, key=lambda m: (-m["confidence"], m["kind"], m["pattern"], m["start"])):
        if taken.free(m["start"], m["end"]):
            taken.add(m["start"], m["end"])
            own.append((m["kind"], m["start"], m["end"], False))
    return sorted(own, key=lambda s: (KINDS.index(s[0]), s[1]))


def _without(bitmap: bytes, finish: Callable[[str, Spans], object], kind: pa.DataType):
    """The rows without candidates, finished."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(bitmap)
        for block, texts in _texts(batches):
            ends, at, out = finder.ends(texts), [], []
            for r, text in enumerate(texts):
                base = base_spans(text)
                if r not in ends or not _candidates(text, ends[r], base):
                    at.append(r)
                    out.append(finish(text, _settled(base, [])))
            yield pa.RecordBatch.from_arrays([block.column("row").take(pa.array(at, pa.int64())), pa.array(out, kind)], ["row", "out"])
    return run


def _with(bitmap: bytes):
    """The rows with candidates, numbered."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, number = _Finder(bitmap), TaskContext.get().partitionId() << 36  # numbers of the stored rows
        for block, texts in _texts(batches):
            found = [(r, more) for r, ends in sorted(finder.ends(texts).items()) if (more := _candidates(texts[r], ends, base_spans(texts[r])))]
            at = pa.array([r for r, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + len(at))), block.column("row").take(at), block.column("text").take(at),
                                              pa.array([more for _, more in found], _CANDIDATES)], ["number", "row", "text", "candidates"])
            number += len(at)
    return run


def _finished(finish: Callable[[str, Spans], object], kind: pa.DataType):
    """The rows with candidates, finished with those whose patterns are in the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, texts in _texts(batches):
            out = [finish(text, _settled(base_spans(text), more or [])) for text, more in zip(texts, block.column("more").to_pylist())]
            yield pa.RecordBatch.from_arrays([block.column("row"), pa.array(out, kind)], ["row", "out"])
    return run


_CANDIDATES = pa.list_(pa.struct([("kind", pa.string()), ("pattern", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
_CANDIDATES_DDL = "array<struct<kind: string, pattern: string, start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
_SPANS_DDL = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def pattern_table(docs: DataFrame, confidence: float = CONFIDENCE) -> DataFrame:
    """``kind, pattern, bit, confidence`` of all patterns of at least ``confidence``."""
    candidates = induce_patterns(docs)
    good = score_patterns(docs, candidates).where(F.col("confidence") >= confidence)
    return store(candidates.join(good, ["kind", "pattern"]), "patterns")


def learn_patterns(docs: DataFrame, confidence: float = CONFIDENCE) -> list[tuple[str, str]]:
    """The (kind, pattern) of ``pattern_table`` as a list, best first, to look at; the operators use the table."""
    return [(r.kind, r.pattern) for r in pattern_table(docs, confidence).orderBy(F.desc("confidence"), "kind", "pattern").collect()]


def _over_rows(packed: DataFrame, finish: Callable[[str, Spans], object], kind: pa.DataType, ddl: str) -> DataFrame:
    """``row, out``: ``finish`` of the text and its spans, for every row of ``packed`` (``row, text``).

    What a text holds depends on the text and the patterns alone, so the rows with candidates, the only ones that travel, are the
    same in both passes.
    """
    patterns = pattern_table(packed.select("text"))
    bitmap = _bitmap(patterns)
    schema = T.StructType([packed.schema["row"], *T.StructType.fromDDL(f"out {ddl}").fields])
    plain = packed.mapInArrow(_without(bitmap, finish, kind), schema)
    if not zlib.decompress(bitmap):
        return plain
    wide = T.StructType([*T.StructType.fromDDL("number long").fields, packed.schema["row"], *T.StructType.fromDDL(f"text string, candidates {_CANDIDATES_DDL}").fields])
    rows = store(packed.mapInArrow(_with(bitmap), wide), "pii-candidates")
    found = rows.select("number", F.explode("candidates").alias("c")).select("number", "c.*").join(patterns.drop("bit"), ["kind", "pattern"])
    more = found.groupBy("number").agg(F.collect_list(F.struct("kind", "pattern", "start", "end", "confidence")).alias("more"))
    rest = rows.drop("candidates").join(more, "number", "left").select("row", "text", "more")
    return plain.unionByName(rest.mapInArrow(_finished(finish, kind), schema))


def find_pii(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row: kind, start, end (code points, end exclusive), base (found by form).

    Emails, IPv4 addresses, card numbers (16 to 19 digits, Luhn) and phone numbers (8 to 15 digits after a plus) are
    base spans, per kind leftmost and non-overlapping; spans of different kinds may overlap. Patterns add spans that
    overlap no other. Null text counts as empty; repeated rows get the same spans; other columns are ignored; an empty
    table gives an empty result. Only the pattern statistics and the texts that hold something behind a pattern are shuffled.
    """
    packed = docs.select(F.struct(F.col(id_column).alias("id")).alias("row"), F.col(text_column).alias("text"))
    found = _over_rows(packed, lambda text, spans: [dict(zip(("kind", "start", "end", "base"), s)) for s in spans], _SPANS, _SPANS_DDL)
    return found.select(F.col("row.id").alias("doc_id"), F.col("out").alias("spans"))


def pii_report(docs: DataFrame) -> DataFrame:
    """``doc_id``, the number of base spans of each kind, the SHA-256 of the base spans' list and the list of all spans."""
    found = find_pii(docs)

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _masked(text: str, spans: Spans) -> str:
    at, parts = 0, []
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def mask_pii(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with every found span replaced by its kind in brackets (overlapping spans by the first's); null stays null.

    All other columns stay, but for ``n_chars``, which is counted anew where present.
    """
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[text_column].alias("text"))
    masked = _over_rows(packed, _masked, pa.string(), "string")
    masked = masked.withColumn("masked", F.when(F.col("row").getField(text_column).isNotNull(), F.col("out")))
    columns = {c: F.col("row").getField(c) for c in docs.columns} | {text_column: F.col("masked")}
    if "n_chars" in columns:
        columns["n_chars"] = F.length("masked").cast(docs.schema["n_chars"].dataType)
    return masked.select(*[v.alias(c) for c, v in columns.items()])
