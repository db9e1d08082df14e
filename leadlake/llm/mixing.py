"""Mixing sources to target weights by hierarchical budgets over a tree of levels.

The leaves of the tree are the distinct values of the level columns (domain, language,
source). A leaf can give its tokens times ``max_epochs``, a node what its leaves can give.
The token budget goes down level by level: siblings share their parent's budget by weight,
and what a sibling cannot use goes to its siblings first; only when they are all full does
it stay with the parent, whose own siblings have it then, as the parent's capacity is the
sum of theirs. In each leaf, whole epochs are taken first and then a token prefix of one more
epoch, in an order that a seed, the epoch and the id settle.

At scale: the tree is one small row per leaf. Siblings are settled by windows ordered by
capacity over weight, without any loop over nodes. Prefixes: a leaf may hold a third of all
rows, so its order is cut into 4096 parts by the hash; whole parts are decided by their sums,
and rows are ranked only in the one part where the budget ends. Texts are read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from leadlake.llm.common import WORD
from leadlake.session import store

PART_DIGITS = 3  # hexadecimal digits: 4096 parts of a leaf


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    found = F.coalesce(*[F.when(F.col(level) == k, F.lit(v)) for k, v in weights.items()], F.lit(1)) if weights else F.lit(1)
    return found.cast("double")


def budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int) -> DataFrame:
    """Adds ``budget`` (whole tokens) to one row per leaf with its ``tokens``.

    The whole budget is ``share`` of all tokens. A node without a weight has 1; weights are
    whole numbers, so that sums do not depend on their order.
    """
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    out = leaves.withColumn("capacity", F.col("tokens").cast("double") * max_epochs)
    out = out.withColumn("given", F.lit(float(int(total * share))))
    for depth, level in enumerate(levels):
        path = list(levels[:depth + 1])
        nodes = out.groupBy(*path).agg(F.sum("capacity").alias("cap"), F.first("given").alias("given"))
        nodes = nodes.withColumn("w", _weight(level, weights.get(level, {})))
        order = Window.partitionBy(*path[:-1]).orderBy(F.col("cap") / F.col("w"), level)
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        onward = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("full", F.col("cap") / F.col("w") <= (F.col("given") - before) / onward)
        siblings = Window.partitionBy(*path[:-1])
        taken = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(siblings), F.lit(0.0))
        open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(siblings)
        nodes = nodes.withColumn("part", F.when(F.col("full"), F.col("cap")).otherwise(
            F.least(F.col("cap"), F.col("w") * ((F.col("given") - taken) / open_w))))
        out = out.drop("given").join(nodes.select(*path, F.col("part").alias("given")), path)
    return out.withColumn("budget", F.floor(F.col("given") + 0.000001).cast("bigint")).drop("capacity", "given")


def mix(
    docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: float = 1.0,
    max_epochs: int = 4, seed: int = 42, id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, the levels, n_tokens, leaf_budget, copies.

    Tokens are words. ``copies`` is how often the mixture takes the document: the whole epochs
    of its leaf, and one more in the prefix. The prefix ends with the document that reaches the
    budget. Null levels are "unknown", a null text has no token, repeated rows are documents of
    their own; rows equal in id and tokens are interchangeable. An empty table stays empty.
    """
    levels = list(levels)
    rows = store(docs.select(
        F.col(id_column).alias("doc_id"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in levels],
        F.coalesce(F.regexp_count(F.col(text_column), F.lit(WORD)), F.lit(0)).cast("bigint").alias("n_tokens"),
    ))
    leaves = store(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")))
    leaves = budgets(leaves, levels, weights, share, max_epochs)
    leaves = store(leaves.select(
        *levels, F.col("budget").alias("leaf_budget"),
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("bigint").alias("epochs"),
    ).join(leaves.select(*levels, "tokens"), levels).withColumn("rest", F.col("leaf_budget") - F.col("epochs") * F.col("tokens")))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    rows = rows.join(leaves.drop("tokens"), levels).withColumn("key", key)
    rows = rows.withColumn("part", F.substring("key", 1, PART_DIGITS))
    sums = rows.groupBy(*levels, "part").agg(F.sum("n_tokens").alias("in_part"))
    earlier = Window.partitionBy(*levels).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.withColumn("before", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)))
    rows = rows.join(parts, [*levels, "part"])
    ends_here = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("in_part") > F.col("rest"))
    whole = rows.where(~ends_here).withColumn("taken", F.col("before") + F.col("in_part") <= F.col("rest"))
    # a part past the end of the budget, or one without tokens at its end, is not taken
    whole = whole.withColumn("taken", F.col("taken") & (F.col("before") < F.col("rest")))
    inside = Window.partitionBy(*levels).orderBy("key", "doc_id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    cut = rows.where(ends_here).withColumn(
        "taken", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)) < F.col("rest"))
    return whole.unionByName(cut).select(
        "doc_id", *levels, "n_tokens", "leaf_budget",
        (F.col("epochs") + F.col("taken").cast("bigint")).alias("copies"),
    )


DOMAIN_SQL = """case when regexp_extract(source, '([0-9]+)$', 1) = '' or source is null then 'other'
    when source = 'src0' then 'crawl'
    when regexp_extract(source, '([13579])$', 1) <> '' then 'curated' else 'forum' end"""
LEVELS = ("domain", "lang", "source")
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"crawl": 40, "curated": 35, "forum": 20, "other": 5},
    "lang": {"en": 50, "de": 20, "fr": 15, "es": 15, "unknown": 1},
}


def with_domain(docs: DataFrame) -> DataFrame:
    """The domain of a document: the family of its source."""
    return docs.withColumn("domain", F.expr(DOMAIN_SQL))


def _case(level: str) -> str:
    cases = " ".join(f"when {level} = '{k}' then {v}" for k, v in WEIGHTS.get(level, {}).items())
    return f"cast(case {cases} else 1 end as double)" if cases else "cast(1 as double)"


def _level_sql(depth: int) -> str:
    path, parent = ", ".join(LEVELS[:depth + 1]), ", ".join(LEVELS[:depth])
    by = f"partition by {parent}" if parent else ""
    above = "g0" if depth == 0 else f"g{depth}"
    return f"""
n{depth} as (select {path}, sum(capacity) cap, any_value(given) given, {_case(LEVELS[depth])} w from {above} group by {path}),
o{depth} as (select *, cap / w <= (given - coalesce(sum(cap) over (s rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (s rows between current row and unbounded following) is_full
    from n{depth} window s as ({by} order by cap / w, {LEVELS[depth]})),
p{depth} as (select {path}, case when is_full then cap else least(cap, w * ((given - coalesce(sum(case when is_full then cap end) over (s), 0))
    / sum(case when not is_full then w end) over (s))) end given from o{depth} window s as ({by})),
g{depth + 1} as (select {', '.join(LEVELS)}, tokens, capacity, p{depth}.given
    from {above} join p{depth} using ({path})),"""


def oracle(share: float, max_epochs: int, seed: int) -> str:
    """The same mixture in SQL, without parts: a running total over each whole leaf."""
    return f"""
with r as (select doc_id, {DOMAIN_SQL} as domain, coalesce(lang, 'unknown') lang, coalesce(source, 'unknown') source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint n_tokens from documents),
leaf as (select domain, lang, source, sum(n_tokens)::bigint tokens from r group by all),
g0 as (select *, tokens::double * {max_epochs} capacity, floor((select sum(tokens) from leaf) * {share}::double) given from leaf),
{''.join(_level_sql(d) for d in range(len(LEVELS)))}
b as (select domain, lang, source, tokens, floor(given + 0.000001)::bigint leaf_budget,
    case when tokens > 0 then floor(floor(given + 0.000001) / tokens)::bigint else 0 end epochs from g{len(LEVELS)}),
k as (select r.*, leaf_budget, epochs, leaf_budget - epochs * tokens rest,
    md5('{seed}:' || epochs || ':' || coalesce(doc_id::varchar, 'null')) as k from r join b using (domain, lang, source)),
c as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by k, doc_id, n_tokens
    rows between unbounded preceding and 1 preceding), 0) before_it from k)
select doc_id, domain, lang, source, n_tokens, leaf_budget, (epochs + (before_it < rest)::bigint)::bigint as copies from c"""
