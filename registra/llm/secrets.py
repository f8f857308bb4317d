"""Secret scans: three fixed kinds of secrets by pattern, and unknown ones by the entropy of a sliding window.

A candidate is a long run of one alphabet. A window slides over it and its Shannon entropy is kept by incremental counts:
one character enters, one leaves, and the sum of c*log2(c) changes by two terms. Windows are judged per character class
(hexadecimal digits, letters and digits), and the hot windows of a candidate become one span. An allow-list suppresses
candidates that only look random: identifiers of common formats, examples and placeholders, and runs in alphabetical order.
Spans of the fixed kinds always stay.

Built-in functions only, one projection over the whole text, no shuffle. Places are code points, ends exclusive.
Defined cases: a null or empty text has no spans; repeated rows are scanned one by one; an empty table gives an empty table;
columns of the input are carried in a struct whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of [A-Z0-9] after AKIA is taken whole, so a run that is too short holds no longer one.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
LEAST_VALUE = 6


@dataclass(frozen=True)
class CharacterClass:
    """Candidates are runs of `characters`; a window is hot from `bits` of entropy on and with `needs` somewhere in it."""

    kind: str
    characters: str
    least: int
    window: int
    bits: float
    needs: tuple[str, ...] = ()


CLASSES = (
    CharacterClass("entropy_hex", "0-9a-fA-F", 20, 20, 3.0, ("[0-9]", "[a-fA-F]")),
    CharacterClass("entropy_text", "A-Za-z0-9+/_=-", 20, 20, 3.6, ("[0-9]", "[A-Za-z]")),
)

#: A candidate that matches one of these is not a secret.
ALLOWED = (
    r"^[0-9]+$",
    r"^[A-Za-z]+$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|0123456789|abcdefgh|deadbeef",
    r"^(?:[A-Za-z]+[/_=-]+)+[A-Za-z]*[0-9]{0,4}$",
    r"^(?:[0-9]+[/_=-]+)+[0-9]*$",
    r"(.)\1{7,}",
)


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,end,found>>: gaps and matches in turn give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    sized = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), found.alias("found"))
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    placed = F.aggregate(
        sized,
        F.struct(F.lit(0).alias("at"), empty.alias("spans")),
        lambda seen, x: F.struct(
            (seen["at"] + x["gap"] + F.length(x["found"])).alias("at"),
            F.concat(
                seen["spans"],
                F.array(
                    F.struct(
                        (seen["at"] + x["gap"]).alias("start"),
                        (seen["at"] + x["gap"] + F.length(x["found"])).alias("end"),
                        x["found"].alias("found"),
                    )
                ),
            ).alias("spans"),
        ),
        lambda seen: seen["spans"],
    )
    # Most texts have no match: they are not split at all.
    return F.when(F.rlike(text, F.lit(pattern)), placed).otherwise(empty)


def _kinds(found: Column, kind: str, order: int) -> Column:
    return F.transform(
        found, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("order"), x["end"].alias("end"), F.lit(kind).alias("kind"))
    )


def hot_stretch(run: Column, window: int, bits: float) -> Column:
    """First and last start of the windows of a run with at least `bits` of entropy, as a struct; null if there are none.

    State of the fold: the window's characters, the sum of c*log2(c) over their counts, and the stretch so far. Only the counts of the
    character that enters and of the one that leaves change; both are read from the window, so a run costs linear time.
    """

    weights = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])

    def weight(count: Column) -> Column:
        return F.get(weights, count)

    def times(character: Column, held: Column) -> Column:
        return F.length(held) - F.length(F.replace(held, character, F.lit("")))

    start = F.struct(
        F.lit("").alias("held"),
        F.lit(0.0).alias("sum"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
        F.lit(0).alias("at"),
    )

    def step(state: Column, enters: Column) -> Column:
        held, full = state["held"], state["at"] >= window
        leaves = F.substring(held, 1, 1)
        had = times(enters, held)
        lost = times(leaves, held) + F.when(leaves == enters, 1).otherwise(0)
        total = state["sum"] + weight(had + 1) - weight(had) + F.when(full, weight(lost - 1) - weight(lost)).otherwise(F.lit(0.0))
        begins = state["at"] - (window - 1)
        hot = (begins >= 0) & (F.log2(F.lit(float(window))) - total / window >= bits - 1e-9)
        return F.struct(
            F.concat(F.when(full, F.substring(held, 2, window - 1)).otherwise(held), enters).alias("held"),
            total.alias("sum"),
            F.when(hot, F.coalesce(state["first"], begins)).otherwise(state["first"]).alias("first"),
            F.when(hot, begins).otherwise(state["last"]).alias("last"),
            (state["at"] + 1).alias("at"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["first"].isNotNull(), F.struct(state["first"].alias("first"), (state["last"] + window).alias("end")))

    return F.aggregate(F.split(run, ""), start, step, finish)


def _allowed(found: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | found.rlike(pattern)
    return out


def _entropy_spans(runs: Column, kind: CharacterClass, order: int) -> Column:
    def wanted(x: Column) -> Column:
        out = ~_allowed(x["found"])
        for pattern in kind.needs:
            out = out & x["found"].rlike(pattern)
        return out

    hot = F.transform(F.filter(runs, wanted), lambda x: F.struct(x["start"].alias("start"), hot_stretch(x["found"], kind.window, kind.bits).alias("hot")))
    return F.transform(
        F.filter(hot, lambda x: x["hot"].isNotNull()),
        lambda x: F.struct(
            (x["start"] + x["hot"]["first"]).alias("start"), F.lit(order).alias("order"), (x["start"] + x["hot"]["end"]).alias("end"), F.lit(kind.kind).alias("kind")
        ),
    )


def scan(docs: DataFrame, text: str = "text", classes: tuple[CharacterClass, ...] = CLASSES) -> DataFrame:
    """`docs` as a struct `row`, with `base` and `spans`: arrays of (start, order, end, kind), sorted.

    `spans` adds to `base` the hot stretches that no base span covers.
    """
    body = F.coalesce(F.col(f"row.`{text}`").cast("string"), F.lit(""))
    runs = [f"run_{i}" for i in range(len(classes))]
    found = docs.select(F.struct("*").alias("row")).select(
        "row",
        spans(body, ASSIGN).alias("assign"),
        spans(body, ACCESS).alias("access"),
        spans(body, HEX).alias("hex"),
        *[
            spans(body, f"(?<![{c.characters}])[{c.characters}]{{{c.least},}}").alias(name)
            for c, name in zip(classes, runs, strict=True)
        ],
    )
    valued = F.filter(
        "assign", lambda x: F.length(F.regexp_extract(x["found"], "^" + ASSIGN, 2)) >= LEAST_VALUE
    )
    base = found.select(
        "row", *runs, F.sort_array(F.concat(_kinds(valued, "assign", 0), _kinds(F.col("access"), "access", 1), _kinds(F.col("hex"), "hex", 2))).alias("base")
    )
    added = F.concat(*[_entropy_spans(F.col(name), c, 3 + i) for i, (c, name) in enumerate(zip(classes, runs, strict=True))])
    judged = base.select("row", "base", added.alias("added"))
    new = F.filter("added", lambda x: ~F.exists("base", lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))
    # Filters on the spans stay above the projections, which they would otherwise expand: no filter is moved past an
    # expression that Spark may not evaluate twice, and the partition's number (never negative) is one.
    found_spans = F.when(F.spark_partition_id() >= 0, F.sort_array(F.concat("base", new)))
    return judged.select("row", F.when(F.spark_partition_id() >= 0, F.col("base")).alias("base"), found_spans.alias("spans"))


def written(found: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
