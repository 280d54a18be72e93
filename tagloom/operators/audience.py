"""Audiences: set algebra over packed members, and containers that keep long runs of users as runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions.packing import SIGNED, WORD_BITS, IdSpace
from tagloom.operators.bitmaps import VALUE_KEYS

# Bytes of one (word, bits) and of one (first, last).
WORD_BYTES, RUN_BYTES = 12, 8
NO_WORDS, NO_RUNS = "array<struct<word:int,bits:bigint>>", "array<struct<first:int,last:int>>"


@dataclass(frozen=True)
class Audience:
    """An expression over tag values: ``a & b``, ``a | b``, ``a - b`` (in a and not in b)."""

    kind: str
    parts: tuple

    def __and__(self, other: Audience) -> Audience:
        return Audience("and", (self, other))

    def __or__(self, other: Audience) -> Audience:
        return Audience("or", (self, other))

    def __sub__(self, other: Audience) -> Audience:
        return Audience("minus", (self, other))

    def leaves(self) -> list[tuple[str, str | None]]:
        """The distinct tag values that the expression names, in order."""
        own = [self.parts] if self.kind == "has" else [leaf for part in self.parts for leaf in part.leaves()]
        return list(dict.fromkeys(own))


def has(code: str, value: str | None = None) -> Audience:
    """Users that have this value of a tag, or any value of it."""
    return Audience("has", (code, value))


COMBINE: dict[str, Callable[[Column, Column], Column]] = {
    "and": lambda a, b: a.bitwiseAND(b),
    "or": lambda a, b: a.bitwiseOR(b),
    "minus": lambda a, b: a.bitwiseAND(F.bitwise_not(b)),
}


def _holds(leaf: tuple[str, str | None]) -> Column:
    code, value = leaf
    held = F.col("tag_code") == code
    return held if value is None else held & (F.col("tag_value") == value)


def audience_chunks(members: DataFrame, audience: Audience) -> DataFrame:
    """The users of an audience as packed members: ``(bucket, n_users, words array<(word, bits)>)``.

    ``members`` are chunks or containers. Packed rows of the values that the audience names cross the network once,
    to their bucket; there the words of all values are put side by side, and the expression is evaluated on 64 users
    at a time. A bucket holds 512 words for each value at most, so no group grows with the number of users.
    """
    leaves = audience.leaves()
    named = members.filter(reduce(lambda a, b: a | b, map(_holds, leaves))).repartition("bucket")
    columns = [F.bit_or(F.when(_holds(leaf), F.col("bits"))).alias(f"of_{i}") for i, leaf in enumerate(leaves)]
    words = opened(named).groupBy("bucket", "word").agg(*columns)

    def bits(node: Audience) -> Column:
        if node.kind == "has":
            return F.coalesce(F.col(f"of_{leaves.index(node.parts)}"), F.lit(0).cast("bigint"))
        return reduce(COMBINE[node.kind], map(bits, node.parts))

    held = words.select("bucket", "word", bits(audience).alias("bits")).filter("bits <> 0")
    return held.groupBy("bucket").agg(
        F.sum(F.bit_count("bits")).alias("n_users"),
        F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("words"),
    )


def containers(chunks: DataFrame) -> DataFrame:
    """Chunks whose users lie in few runs of consecutive places keep the runs instead of the words.

    Adds ``runs array<(first, last)>``, both ends included; of words and runs the one that takes fewer bytes is
    kept and the other is empty. A value that all users of a bucket have is one run instead of 512 words.
    """
    every = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))

    def neighbour(i: Column, step: int, word: Column, bit: Callable[[Column], Column]) -> Column:
        other = F.get("words", i + step)
        return F.when(other["word"] == word + step, bit(other["bits"])).otherwise(F.lit(0).cast("bigint"))

    def places(edge: Callable[[Column, Column], Column]) -> Column:
        def of_word(w: Column, i: Column) -> Column:
            own = F.filter(every, lambda bit: F.bit_get(edge(w, i), bit) == 1)
            return F.transform(own, lambda bit: w["word"] * WORD_BITS + bit)

        return F.flatten(F.transform("words", of_word))

    def starts(w: Column, i: Column) -> Column:
        before = neighbour(i, -1, w["word"], lambda b: F.shiftrightunsigned(b, WORD_BITS - 1))
        return w["bits"].bitwiseAND(F.bitwise_not(F.shiftleft(w["bits"], 1).bitwiseOR(before)))

    def ends(w: Column, i: Column) -> Column:
        after = neighbour(i, 1, w["word"], lambda b: F.shiftleft(b, WORD_BITS - 1))
        return w["bits"].bitwiseAND(F.bitwise_not(F.shiftrightunsigned(w["bits"], 1).bitwiseOR(after)))

    # The number of runs is known from the words alone; places are written out for the chunks that keep runs.
    n_runs = F.aggregate(
        F.transform("words", lambda w, i: F.bit_count(starts(w, i))), F.lit(0), lambda total, n: total + n
    )
    as_runs = n_runs * RUN_BYTES < F.size("words") * WORD_BYTES
    runs = F.transform(F.arrays_zip(places(starts).alias("first"), places(ends).alias("last")), lambda r: r).cast(NO_RUNS)
    # Two steps: within one, the lambdas of the runs would see the new words.
    chosen = chunks.withColumn("_as_runs", as_runs)
    chosen = chosen.withColumn("runs", F.when(F.col("_as_runs"), runs).otherwise(F.array().cast(NO_RUNS)))
    words = F.when(F.col("_as_runs"), F.array().cast(NO_WORDS)).otherwise(F.col("words"))
    return chosen.withColumn("words", words).select(*chunks.columns, "runs")


def opened(members: DataFrame) -> DataFrame:
    """A row for each word of chunks or containers: ``(tag_code, tag_value, bucket, word, bits)``.

    A word that several runs reach into has a row for each; or-ing the bits puts them together.
    """
    keys = [c for c in (*VALUE_KEYS, "bucket") if c in members.columns]
    if "runs" not in members.columns:
        return members.select(*keys, F.inline("words"))
    full = F.lit(-1).cast("bigint")

    def part(run: Column, word: Column) -> Column:
        low = F.greatest(run["first"] - word * WORD_BITS, F.lit(0))
        high = F.least(run["last"] - word * WORD_BITS, F.lit(WORD_BITS - 1))
        up = F.call_function("shiftleft", full, low)
        down = F.call_function("shiftrightunsigned", full, F.lit(WORD_BITS - 1) - high)
        return F.struct(word.cast("int").alias("word"), up.bitwiseAND(down).alias("bits"))

    def of_run(run: Column) -> Column:
        words = F.sequence(F.shiftright(run["first"], 6), F.shiftright(run["last"], 6))
        return F.transform(words, lambda word: part(run, word))

    return members.select(*keys, F.inline(F.concat("words", F.flatten(F.transform("runs", of_run)))))


def container_users(members: DataFrame, ids: IdSpace = SIGNED) -> DataFrame:
    """Containers back to ids: ``(tag_code, tag_value, uid)``. A run is written out without its bits."""
    every = F.sequence(F.lit(0), F.lit(WORD_BITS - 1))

    def of_word(w: Column) -> Column:
        return F.transform(F.filter(every, lambda bit: F.bit_get(w["bits"], bit) == 1), lambda bit: w["word"] * WORD_BITS + bit)

    of_runs = F.flatten(F.transform("runs", lambda r: F.sequence(r["first"], r["last"])))
    places = F.concat(F.flatten(F.transform("words", of_word)), of_runs)
    keys = [c for c in VALUE_KEYS if c in members.columns]
    rows = members.select(*keys, "bucket", F.explode(places).alias("_place"))
    return rows.select(*keys, ids.id_of(F.col("bucket"), F.col("_place").cast("bigint")).alias("uid"))
