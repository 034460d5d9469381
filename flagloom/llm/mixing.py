"""Mixing sources to target weights, with DataFrame functions only.

A source with a share ``p`` of all words gets a weight in proportion to
``p ** exponent``: 1 keeps the natural shares, 0 makes all sources equal. The
exponent is bisected to the smallest that respects a repetition limit, or to
the one whose weights have a target entropy, whichever is larger; it goes above
1 where the natural shares have more entropy than the target. A source's
budget is its weight's part of the total; it is realised as whole passes over
its blocks (permutations, one a pass) and a last pass that stops where the
budget is met.

Nothing is grouped by source alone but four numbers: a document falls into a
block by a hash, blocks are summed before they are ordered, and a pass orders
its blocks by slices of the permutation, so a source of a third of all rows is
spread like any other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flagloom.llm.common import settle

#: Exponents tried at once; each round narrows the interval to one step of its grid.
_GRID, _ROUNDS = 32, 6
_SLICE_BITS = 8


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_shares(docs: DataFrame, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(source, tokens, documents)``; null is a source of its own."""
    return (docs.groupBy(F.col(source_col).alias("source"))
            .agg(F.sum(word_count(F.col(text_col))).alias("tokens"), F.count("*").alias("documents")))


def _bisect(shares: DataFrame, passes: Column, low: float = 0.0, high: float = 1.0) -> float:
    """The smallest exponent in [low, high] at which ``passes`` (an aggregate
    over the sources, falling into true once as the exponent grows) is true;
    ``high`` if none is. Every round tries a grid in one job."""
    for _ in range(_ROUNDS):
        step = (high - low) / _GRID
        grid = F.explode(F.array(*[F.lit(low + i * step) for i in range(_GRID + 1)]))
        hit = (shares.select("p", grid.alias("x")).groupBy("x").agg(passes.alias("ok"))
               .where("ok").agg(F.min("x")).first()[0])
        if hit is None:
            return high
        low, high = max(low, hit - step), hit
    return high


def _beyond_one(shares: DataFrame, met: Column, within: Column) -> float:
    """The smallest exponent above 1 at which ``met`` is true, or 1 if ``within``
    (false from some exponent on) is not true there."""
    low, high = 1.0, 2.0
    while True:
        at = shares.select("p", F.lit(high).alias("x")).agg(met.alias("met"), within.alias("within")).first()
        if at["met"]:
            break
        if not at["within"]:
            return 1.0
        low, high = high, 2 * high
    found = _bisect(shares, met, low, high)
    return found if shares.select("p", F.lit(found).alias("x")).agg(within.alias("ok")).first()["ok"] else 1.0


def mixing_weights(shares: DataFrame, max_repeats: float = 4.0, entropy: float | None = None,
                   budget: int | None = None) -> DataFrame:
    """``shares`` with ``weight``, ``exponent`` and ``budget`` (words) of every source that has words.

    ``entropy``: target as a part (0 to 1) of the greatest possible, that of
    equal weights. ``max_repeats``: no source may get more than so many passes.
    ``budget``: words in total; ``None`` means the least total at which every
    source gets a whole pass. Then the limit bounds the exponent from below;
    with a stated budget that cannot respect the limit even at exponent 1, the
    sources' budgets are cut to the limit. A target below the natural shares'
    entropy takes an exponent above 1; if none meets it within the limit (as
    with sources of equal size) the natural shares stay (exponent 1). ``None``
    goes as far as the limit.
    """
    shares = shares.where("tokens > 0")
    total = shares.agg(F.sum("tokens"), F.max("tokens"), F.count("*")).first()  # words, of the largest, sources
    if not total[0]:
        return shares.select("*", *(F.lit(None).cast("double").alias(c) for c in ("weight", "exponent")),
                             F.lit(None).cast("long").alias("budget"))
    # shares in parts of the largest, whose powers stay 1
    p = shares.select((F.col("tokens") / F.lit(total[1])).alias("p"))
    p = settle(p, "mixing-shares")
    power = F.pow("p", F.col("x"))
    # passes of a source: weight * budget / tokens
    if budget is None:
        most = F.try_divide(F.max(power / F.col("p")), F.min(power / F.col("p")))
    else:
        most = F.max(power / F.col("p")) / F.sum(power) * F.lit(budget / total[1])
    within = most <= max_repeats * (1 + 1e-9)
    exponent = _bisect(p, within)
    if entropy is not None and total[2] > 1:
        spread = F.log(F.sum(power)) - F.sum(power * F.log(power)) / F.sum(power)
        met = spread <= entropy * F.log(F.lit(float(total[2])))
        least = _bisect(p, met)
        exponent = max(exponent, least)
        # above 1 the entropy falls towards that of the largest sources alone
        largest = p.where("p = 1").count()
        if least == 1.0 and math.log(largest) < entropy * math.log(total[2]):
            exponent = _beyond_one(p, met, within)
    norm = p.agg(F.sum(F.pow("p", F.lit(exponent))), F.min(F.pow("p", F.lit(exponent - 1)))).first()
    amount = float(budget) if budget is not None else total[1] * norm[0] / norm[1]
    weight = F.pow(F.col("tokens") / F.lit(total[1]), F.lit(exponent)) / F.lit(norm[0])
    words = F.least(F.round(weight * amount), F.floor(F.col("tokens") * F.lit(float(max_repeats))))
    return shares.select("*", weight.alias("weight"), F.lit(exponent).alias("exponent"),
                         words.cast("long").alias("budget"))


def plan_blocks(docs: DataFrame, weights: DataFrame, seed: int, source_col: str) -> DataFrame:
    """``(_source, _block, _pass, _order)``: the blocks each pass takes. A pass
    is a permutation of the source's blocks; a block is taken if the middle of it
    lies within what is left of the budget."""
    blocks = (docs.select(F.col(source_col).alias("_source"), F.col("_block"), F.col("_words"))
              .groupBy("_source", "_block").agg(F.sum("_words").alias("_words")))
    goal = weights.select(F.col("source").alias("_goal_source"), "tokens", "budget")
    blocks = blocks.join(goal, F.col("_source").eqNullSafe(F.col("_goal_source"))).drop("_goal_source")
    passes = F.sequence(F.lit(0), F.ceil(F.col("budget") / F.col("tokens")).cast("int") - 1)
    laid = (blocks.where("budget > 0").withColumn("_pass", F.explode(passes))
            .withColumn("_order", F.xxhash64(F.lit(seed), F.col("_pass"), F.col("_source"), F.col("_block")))
            .withColumn("_left", F.col("budget") - F.col("_pass") * F.col("tokens")))
    whole = laid.where("_left >= tokens").select("_source", "_block", "_pass", "_order")
    part = laid.where("_left < tokens").withColumn("_slice", F.shiftrightunsigned("_order", 64 - _SLICE_BITS))
    # prefix sums in two steps: over a source's slices, then within a slice
    sliced = part.groupBy("_source", "_slice").agg(F.sum("_words").alias("_sum"))
    ahead = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = sliced.select(F.col("_source").alias("_s"), F.col("_slice").alias("_sl"),
                           F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_ahead"))
    within = (Window.partitionBy("_source", "_slice").orderBy("_order", "_block")
              .rowsBetween(Window.unboundedPreceding, -1))
    part = (part.withColumn("_before", F.coalesce(F.sum("_words").over(within), F.lit(0)))
            .join(sliced, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_slice") == F.col("_sl")))
            .where(F.col("_before") + F.col("_ahead") + F.col("_words") / 2 <= F.col("_left")))
    return whole.unionByName(part.select("_source", "_block", "_pass", "_order"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                max_repeats: float = 4.0, entropy: float | None = 0.9, budget: int | None = None,
                block_words: int = 1 << 20, least_blocks: int = 1024, seed: int = 17) -> DataFrame:
    """Rows of ``docs`` as the mixture takes them, with ``mix_pass`` (from 0),
    ``mix_order`` (the order of the pass's blocks) and ``mix_weight``.

    Blocks hold ``block_words`` on average over all sources, less where the
    input would not fill ``least_blocks``; a budget is met to within one block.
    A row appears once for each pass that takes its block. With ``budget``
    ``None`` every row appears at least once: the largest source passes once,
    smaller ones up to ``max_repeats`` times (the other way round at an exponent
    above 1), so nothing is lost. Rows without a
    word weigh nothing: they appear in the passes that take their block; those
    of a source without any word appear once with weight 0. Null is a source;
    repeated rows stay repeated; columns of these three names are replaced;
    empty input gives no rows.
    """
    docs = docs.drop("mix_pass", "mix_order", "mix_weight")
    names = docs.columns
    shares = settle(source_shares(docs, source_col, text_col), "mixing-sources")
    weights = settle(mixing_weights(shares, max_repeats, entropy, budget), "mixing-weights")
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    n_blocks = max(least_blocks, -(-total // block_words))
    block = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col)), F.lit(n_blocks)).alias("_block")
    light = docs.select(F.col(source_col), block, word_count(F.col(text_col)).alias("_words"))
    plan = settle(plan_blocks(light, weights, seed, source_col)
                  .join(weights.select(F.col("source").alias("_w"), F.col("weight")),
                        F.col("_source").eqNullSafe(F.col("_w")))
                  .select("_source", F.col("_block").alias("_b"), F.col("_pass").alias("mix_pass"),
                          F.col("_order").alias("mix_order"), F.col("weight").alias("mix_weight")), "mixing-plan")
    taken = (docs.select(*names, block)
             .join(plan, F.col(source_col).eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("_b"))))
    out = [*names, "mix_pass", "mix_order", "mix_weight"]
    silent = shares.where("tokens = 0").select(F.col("source").alias("_source"))
    rest = (docs.join(silent, F.col(source_col).eqNullSafe(F.col("_source")), "left_semi")
            .select(*names, F.lit(0).alias("mix_pass"), F.lit(0).cast("long").alias("mix_order"),
                    F.lit(0.0).alias("mix_weight")))
    return taken.select(*out).unionByName(rest)
