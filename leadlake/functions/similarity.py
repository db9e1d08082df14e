"""Token-set similarity of short names, as Column expressions.

The longest common subsequence runs bit-parallel: one bit per character of the first name, in
words of ``WORD`` bits with carries between them, and one addition per word for each character of the second. It only
ever sees distinct column names (a catalog, not lead rows).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadlake.schema import FIELDS, plain_key

WORD = 60  # a sum of two words and a carry stays below 2^62
_FULL = (1 << WORD) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _characters(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def _masks(characters: Column) -> Column:
    """map: character -> its places in the name, as bits of words."""
    words = F.sequence(F.lit(0), F.ceil(F.size(characters) / F.lit(WORD)).cast("int") - 1)

    def places(c: Column) -> Column:
        def word(w: Column) -> Column:
            part = F.slice(characters, w * WORD + 1, WORD)
            bits = F.transform(part, lambda x, i: F.when(x == c, F.expr("1L")).otherwise(F.expr("0L")) * F.pow(F.lit(2.0), i).cast("bigint"))
            return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: s.bitwiseOR(b))

        return F.transform(words, word)

    return F.map_from_entries(F.transform(F.array_distinct(characters), lambda c: F.struct(c, places(c))))


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts; 0 if one is empty."""
    def of(x: Column) -> Column:
        full = F.transform(F.sequence(F.lit(1), F.ceil(F.size(x) / F.lit(WORD)).cast("int")), lambda _: F.lit(_FULL))

        def run(masks: Column) -> Column:
            none = F.transform(full, lambda _: F.lit(0).cast("bigint"))

            def step(rows: Column, c: Column) -> Column:
                pairs = F.arrays_zip(rows.alias("v"), F.coalesce(F.try_element_at(masks, c), none).alias("m"))

                def word(state: Column, p: Column) -> Column:
                    v, m = p["v"], p["m"]
                    total = v + v.bitwiseAND(m) + state["carry"]
                    new = total.bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(F.lit(_FULL))
                    return F.struct(F.shiftright(total, WORD).alias("carry"), F.concat(state["rows"], F.array(new)).alias("rows"))

                start = F.struct(F.lit(0).cast("bigint").alias("carry"), F.array().cast("array<bigint>").alias("rows"))
                return F.aggregate(pairs, start, word)["rows"]

            left = F.aggregate(_characters(b), full, step)
            ones = F.aggregate(left, F.lit(0), lambda s, v: s + F.bit_count(v))
            return F.size(full) * WORD - ones

        return _let(_masks(x), run)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(_let(_characters(a), of))


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != ""))


def token_set_similarity(a: Column, b: Column) -> Column:
    """1.0 if one token set holds the other, else the best ratio of shared and rest tokens; 0 without tokens.

    The ratio of two texts is 2 * LCS / (sum of lengths). Texts that begin with the same shared tokens
    have these in their LCS, so only the rests are compared.
    """
    def scored(t: Column) -> Column:
        left, right = t["left"], t["right"]
        shared = F.array_join(F.array_sort(F.array_intersect(left, right)), " ")
        rest_left, rest_right = (F.array_join(F.array_sort(F.array_except(x, y)), " ") for x, y in ((left, right), (right, left)))

        def best(s: Column) -> Column:
            base, l, r = F.length(s["shared"]), F.length(s["left"]), F.length(s["right"])
            prefix = F.when(base > 0, base + 1).otherwise(0)
            both = 2.0 * (prefix + common_subsequence(s["left"], s["right"])) / (2 * prefix + l + r)
            alone = F.greatest(2.0 * base / (2 * base + 1 + l), 2.0 * base / (2 * base + 1 + r))
            return (F.when((base > 0) & ((l == 0) | (r == 0)), 1.0)
                    .when(base > 0, F.greatest(both, alone)).otherwise(both))

        value = _let(F.struct(shared.alias("shared"), rest_left.alias("left"), rest_right.alias("right")), best)
        return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(value)

    return _let(F.struct(_tokens(a).alias("left"), _tokens(b).alias("right")), scored)


def field_names() -> list[tuple[str, str]]:
    """(field, plain name) for the name and every alias of the canonical fields."""
    return sorted({(f.name, plain_key(n)) for f in FIELDS for n in (f.name, *f.aliases)})


def field_similarities(names: DataFrame, name: str, least: float) -> DataFrame:
    """(name, field, name_score) of distinct names: the best score of the field's aliases, where it reaches ``least``.

    Every name meets the fixed list of aliases; names are catalog entries, not lead rows.
    """
    known = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(n).alias("alias")) for f, n in field_names()])
    pairs = names.select(name).distinct().select(name, F.inline(known))
    scored = pairs.withColumn("score", token_set_similarity(F.col(name), F.col("alias")))
    return scored.groupBy(name, "field").agg(F.max("score").alias("name_score")).where(F.col("name_score") >= least)
