"""Secrets in texts: patterns, and windows of high entropy, in DataFrame functions only.

Entropy candidates are runs of one character class. A window slides over a candidate; the counts of its
characters change by the one that enters and the one that leaves, and with them the sum of c * log2(c), from
which Shannon entropy follows. A candidate gives one span, from its first to its last window over the
class's threshold. Candidates on the allow list give none.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns in listed order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # the runs of AKIA[A-Z0-9]+ with 16 characters or more
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ with 32 characters or more
ASSIGNED_CHARS = 8
BASE_KINDS = ("assign", "access", "hex")

UNIT = 1 << 20  # sums of c * log2(c) are kept in whole units of 2**-20
BLOCK = 256


@dataclass(frozen=True)
class EntropyClass:
    kind: str
    alphabet: str
    window: int
    bits: float
    must_have: tuple[str, ...]

    @property
    def run(self) -> str:
        return f"[{self.alphabet.replace('-', '')}{'-' * ('-' in self.alphabet)}]{{{self.window},}}"

    @property
    def limit(self) -> int:
        """Entropy is at least ``bits`` when the sum of c * log2(c) is at most this."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * UNIT)


CLASSES = (
    EntropyClass("entropy_base64", string.ascii_letters + string.digits + "+/=_-", 24, 4.0, ("[a-z]", "[A-Z]", "[0-9]")),
    EntropyClass("entropy_hex", string.digits + "abcdefABCDEF", 20, 3.0, ("[a-fA-F]", "[0-9]")),
)
# Placeholders, runs in alphabetic or numeric order, and one character repeated.
ALLOWED = r"(?i)example|sample|dummy|placeholder|change_?me|your_|abcdefgh|01234567|12345678|(.)\1{7}"


def weights(window: int) -> list[int]:
    return [0, *(round(c * math.log2(c) * UNIT) for c in range(1, window + 1))]


def _ends(steps: Column) -> Column:
    """Running totals of an array, in blocks, so that a very long array does not cost its square."""
    def totals(part: Column, base: Column) -> Column:
        return F.aggregate(part, F.array(base), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")),
                         lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    sums = F.transform(blocks, lambda part: F.aggregate(part, F.lit(0), lambda acc, x: acc + x))
    bases = totals(sums, F.lit(0))
    return F.flatten(F.transform(blocks, lambda part, b: F.slice(
        totals(part, F.element_at(bases, b + 1)), F.lit(2), F.size(part))))


def _spans(text: str, matches: str, pattern: str) -> Column:
    """(start, end, match) of a pattern's matches, in code points: the text is split at them."""
    gaps = F.split(F.col(text), pattern, -1)
    with_gaps = F.arrays_zip(F.col(matches).alias("match"), F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"))
    ends = _ends(F.transform(with_gaps, lambda x: F.length(x["gap"]) + F.length(x["match"])))
    found = F.transform(F.arrays_zip(F.col(matches).alias("match"), ends.alias("end")), lambda x: F.struct(
        (x["end"] - F.length(x["match"])).alias("start"), x["end"].alias("end"), x["match"].alias("match")))
    return F.when(F.size(matches) > 0, found).otherwise(found_none())


def found_none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,match:string>>")


def _hot_range(match: Column, c: EntropyClass) -> Column:
    """Ends of the first and the last window of a candidate with enough entropy; (0, 0) if there is none."""
    table = F.array(*[F.lit(w) for w in weights(c.window)])
    at = lambda n: F.element_at(table, n + 1)
    places = F.transform(F.split(match, ""), lambda ch: F.position(ch, F.lit(c.alphabet)))
    start = F.struct(
        F.array_repeat(F.lit(0), len(c.alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"),
        F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("i"))

    def step(acc: Column, pair: Column) -> Column:
        into, out = pair["into"], pair["out"]
        same = into == out
        more = F.element_at(acc["counts"], into)
        less = F.when(out > 0, F.element_at(acc["counts"], F.greatest(out, F.lit(1))))
        grown = F.when(same, F.lit(0)).otherwise(at(more + 1) - at(more))
        shrunk = F.when(same | (out == 0), F.lit(0)).otherwise(at(F.greatest(less - 1, F.lit(0))) - at(less))
        total = acc["sum"] + grown + shrunk
        counts = F.transform(acc["counts"], lambda n, j: n + (j + 1 == into).cast("int") - (j + 1 == out).cast("int"))
        i = acc["i"] + 1
        hot = (i >= c.window) & (total <= c.limit)
        return F.struct(
            counts.alias("counts"), total.cast("long").alias("sum"),
            F.when(hot & (acc["first"] == 0), i).otherwise(acc["first"]).alias("first"),
            F.when(hot, i).otherwise(acc["last"]).alias("last"), i.alias("i"))

    leaving = F.concat(F.array_repeat(F.lit(0), c.window), places)
    pairs = F.transform(places, lambda p, i: F.struct(p.alias("into"), F.element_at(leaving, i + 1).alias("out")))
    return F.aggregate(pairs, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _entropy_spans(c: EntropyClass) -> Column:
    candidates = F.filter(c.kind, lambda x: ~F.rlike(x["match"], F.lit(ALLOWED)) & _all(
        [F.rlike(x["match"], F.lit(p)) for p in c.must_have]))
    ranges = F.transform(candidates, lambda x: F.struct(x["start"].alias("at"), _hot_range(x["match"], c).alias("hot")))
    return F.transform(F.filter(ranges, lambda x: x["hot"]["first"] > 0), lambda x: F.struct(
        (x["at"] + x["hot"]["first"] - c.window).alias("start"), (x["at"] + x["hot"]["last"]).alias("end")))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    spans lists kind:start:end (code points, end exclusive) by start, then kind as listed. Entropy spans
    inside a base span say nothing new and are left out. A null text is empty: no spans, the hash of the
    empty string. Rows are looked at one by one, so ids may be null or repeated.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    patterns = dict(zip(BASE_KINDS, (ASSIGN, ACCESS, HEX), strict=True)) | {c.kind: c.run for c in CLASSES}
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(f"m_{k}") for k, p in patterns.items()])
    rows = rows.select("doc_id", *[_spans("text", f"m_{k}", p).alias(k) for k, p in patterns.items()])
    rows = rows.withColumn("assign", F.filter("assign", lambda x: F.length(
        F.regexp_extract(x["match"], ASSIGN, 2)) >= ASSIGNED_CHARS))

    def listed(column: Column, order: int, kind: str) -> Column:
        return F.transform(column, lambda x: F.struct(
            x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    base = F.concat(*[listed(F.col(k), i, k) for i, k in enumerate(BASE_KINDS)])
    rows = rows.withColumn("base", F.array_sort(base))
    added = [listed(_entropy_spans(c), order, c.kind) for order, c in enumerate(CLASSES, len(BASE_KINDS))]
    rows = rows.withColumn("added", F.concat(*added))
    new = F.filter("added", lambda x: ~F.exists("base", lambda b: (b["start"] <= x["start"]) & (x["end"] <= b["end"])))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.array_sort(F.concat(F.col("base"), new))).alias("spans"))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
