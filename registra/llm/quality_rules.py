"""Quality rules: a threshold table compiled into one Spark projection.

Every ratio is a built-in expression over the whole text, so a scan, the ratios and the verdict are one stage without
a shuffle and without user functions. Lines are separated by \\n, words are runs of `[^\\x20\\x09-\\x0D]`.

Defined cases: a null or empty text has no words and fails the base rule; an empty table gives an empty table; repeated
rows are judged one by one; columns of the input are carried untouched whatever their names (the ratios live in a
struct of their own).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from he in is it of on or that the this to was with "
    "als an auf das dem den der des die ein eine er es für im in ist mit nicht sich sie und von zu "
    "au aux de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "al como con de del el en es la las lo los no para por que se su un una y"
).split()


@dataclass(frozen=True)
class Threshold:
    """A ratio must lie in [least, most]; None leaves that side open."""

    ratio: str
    least: float | None = None
    most: float | None = None


#: The table `judge` compiles. Ratios are those of `ratios`.
THRESHOLDS = (
    Threshold("mean_word_length", 2.0, 15.0),
    Threshold("symbols_per_word", most=0.25),
    Threshold("exclamations_per_word", most=0.35),
    Threshold("capital_share", most=0.40),
    Threshold("stop_word_share", least=0.02),
    Threshold("duplicate_line_share", most=0.40),
    Threshold("listed_line_share", most=0.90),
    Threshold("ellipsis_line_share", most=0.30),
)


def split_words(text: Column) -> Column:
    """Words of a text that is not null."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_BREAK, -1))


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` as a struct `row`, with the counts of each text as a struct `counts`."""
    words, lines, keys, bits = F.col("words"), F.col("lines"), F.col("keys"), F.col("bits")
    whole = F.coalesce(F.col(f"row.`{text}`"), F.lit(""))
    # Each step is a projection of its own: what a lambda looks into must be computed once per row, not once per element.
    split = docs.select(F.struct("*").alias("row")).select(
        "row",
        whole.alias("body"),
        split_words(whole).alias("words"),
        F.filter(F.split(whole, "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
    )
    n_words = F.size(words)
    # Windows that may repeat: hash and place packed into one number, so that a plain sort brings equal hashes together.
    numbered = split.select("*", F.length(F.bin(n_words)).alias("bits"))
    hashed = F.transform(
        F.slice(words, F.lit(1), F.greatest(n_words - 2, F.lit(0))),
        lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)), bits).bitwiseOR(
            i.cast("long")
        ),
    )
    keyed = numbered.select("*", F.sort_array(hashed).alias("keys"))

    def hash_of(key: Column) -> Column:
        return F.call_function("shiftright", key, bits)

    likely = F.filter(
        keys,
        lambda x, i: F.coalesce(hash_of(x) == hash_of(F.get(keys, i - 1)), F.lit(False))
        | F.coalesce(hash_of(x) == hash_of(F.get(keys, i + 1)), F.lit(False)),
    )
    # Only those are compared as words, which settles what shortened hashes cannot.
    place = F.transform(likely, lambda x: (x - F.call_function("shiftleft", hash_of(x), bits)).cast("int"))
    compared = keyed.select(
        "row",
        "body",
        "words",
        "lines",
        F.sort_array(
            F.transform(
                place,
                lambda at: F.struct(
                    F.concat_ws(" ", F.get(words, at), F.get(words, at + 1), F.get(words, at + 2)).alias("seen"), at.alias("at")
                ),
            )
        ).alias("windows"),
    )
    windows = F.col("windows")
    repeated = F.filter(
        F.transform(
            windows,
            lambda x, i: F.when(
                F.coalesce(x["seen"] == F.get(windows, i - 1)["seen"], F.lit(False))
                | F.coalesce(x["seen"] == F.get(windows, i + 1)["seen"], F.lit(False)),
                x["at"],
            ),
        ),
        lambda at: at.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array(repeated),
        F.struct(F.lit(0).alias("to"), F.lit(0).alias("total")),
        lambda seen, at: F.struct((at + 3).alias("to"), (seen["total"] + at + 3 - F.greatest(at, seen["to"])).alias("total")),
        lambda seen: seen["total"],
    )
    body = F.col("body")
    n_lines = F.size(lines)
    counts = {
        "n_words": n_words,
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)),
        "n_dup_lines": n_lines - F.size(F.array_distinct(lines)),
        "n_repeat_words": covered,
        "n_lines": n_lines,
        "n_exclamations": F.length(body) - F.length(F.replace(body, F.lit("!"), F.lit(""))),
        "n_capitals": F.regexp_count(body, F.lit("[A-Z]")),
        "n_stop_words": F.size(F.filter(words, lambda x: F.lower(x).isin(*sorted(set(STOP_WORDS))))),
        "n_listed_lines": F.size(F.filter(lines, lambda x: F.ltrim(x).rlike(r"^(?:[-*•]|\d+[.)])\s"))),
        "n_ellipsis_lines": F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))),
    }
    whole_counts = F.struct(*[c.cast("long").alias(n) for n, c in counts.items()])
    # A filter on the counts must not be pushed below the projections, which would expand each into the next. Spark moves
    # no filter past an expression it may not evaluate twice, and the partition's number (never negative) is one.
    return compared.select("row", F.when(F.spark_partition_id() >= 0, whole_counts).alias("counts"))


def ratios(counts: Column) -> dict[str, Column]:
    """The ratios that thresholds can name, over a `counts` struct."""
    per_word = {
        "mean_word_length": "word_chars",
        "symbols_per_word": "n_symbols",
        "exclamations_per_word": "n_exclamations",
        "stop_word_share": "n_stop_words",
    }
    per_line = {
        "duplicate_line_share": "n_dup_lines",
        "listed_line_share": "n_listed_lines",
        "ellipsis_line_share": "n_ellipsis_lines",
    }
    out = {name: _share(counts[part], counts["n_words"]) for name, part in per_word.items()}
    out |= {name: _share(counts[part], counts["n_lines"]) for name, part in per_line.items()}
    out["capital_share"] = _share(counts["n_capitals"], counts["word_chars"])
    return out


def compile_thresholds(counts: Column, thresholds: Sequence[Threshold] = THRESHOLDS) -> Column:
    """One boolean expression: every ratio of the table within its bounds."""
    known, verdict = ratios(counts), F.lit(True)
    for rule in thresholds:
        value = known[rule.ratio]
        if rule.least is not None:
            verdict = verdict & (value >= rule.least)
        if rule.most is not None:
            verdict = verdict & (value <= rule.most)
    return verdict


def judge(docs: DataFrame, text: str = "text", thresholds: Sequence[Threshold] = THRESHOLDS) -> DataFrame:
    """`row` (the document), `counts`, `base_failed` and `kept` for every row of `docs`."""
    counts = F.col("counts")
    failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
    return measured(docs, text).select(
        "row", "counts", failed.alias("base_failed"), (~failed & compile_thresholds(counts, thresholds)).alias("kept")
    )
