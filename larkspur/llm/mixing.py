"""Mix sources to target weights by fitting a subset sum over document lengths.

1. Count documents by (source, exact length).
2. Share the budget among the sources by weight, capped per source, by sums over a
   table with a row per source.
3. Per source: whole epochs first; the rest of the target is met by choosing
   how many documents of each length take one more pass, an even share of every
   length and then a bounded knapsack (bitset dynamic programming) over what is
   left; one document that passes the target by less than is missed is taken too.
4. The documents of a length are chosen by a seeded hash of their id: those up to
   the hash of the last one chosen.  That hash is found by counts over hash buckets
   and a rank within one bucket, so that a very common length is never ranked whole.
   Of rows that share the last hash as many are chosen as are left, by a hash of the row.

The choice is one row per (source, length), which grows with the lengths there are
and not with the documents; texts meet it where they are read, by broadcast up to
``BROADCAST_CELLS`` rows and by a shuffle join beyond.

Cases.  Null text or text without words: size 0, taken 0.  Null source: a
source of its own, after all others.  Rows of one source and length that share a
doc_id (null too) share the hash, and no more of them are chosen than the plan says.
Repeated rows are separate documents.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from larkspur.plans.staging import numbered, stage

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: Target of the whole mix as a share of all words, and of a source as a multiple of its own.
SHARE, CAP = 1.5, 2.0
SEED = 42
#: Leading bits of the hash that make a bucket; rows of the choice that may be broadcast.
BUCKET_BITS, BROADCAST_CELLS = 6, 150_000
#: Words that are left to the dynamic programme, about; more are filled by the longest that fit.
KNAPSACK_WORDS = 1 << 17


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Targets by source (in the order given): weighted shares of the budget, the
    excess over ``cap`` times a source's size reshared until none is above."""
    target = [0.0] * len(sizes)
    left, open_ = share * sum(n for _, n in sizes), list(range(len(sizes)))
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    while open_:
        total = sum(weight[i] for i in open_)
        full = [i for i in open_ if left * weight[i] / total > cap * sizes[i][1]]
        if not full:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in full:
            target[i] = cap * sizes[i][1]
        left -= sum(target[i] for i in full)
        gone = set(full)
        open_ = [i for i in open_ if i not in gone]
    return target


def source_targets(counts: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source_key, source_size, target) of counts (source_key, size, n): what :func:`fill_targets`
    computes, for any number of sources.  Sums alone come to the driver: a source is full once the
    words given for one unit of weight pass ``cap`` times its size over its weight."""
    sizes = counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), (F.first("source_key") == "").alias("last"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("nth") % len(weights) + 1).cast("int"))
    sources = stage(numbered(sizes, "last", "source_key", name="nth").select("source_key", "source_size", weight.alias("weight")), "sources")
    most = F.lit(float(cap)) * F.col("source_size")
    words = sources.agg(F.sum("source_size")).first()[0] or 0
    left, total, open_ = share * words, None, F.lit(True)
    while True:
        row = sources.agg(F.count_if(open_).alias("n"), F.sum(F.when(open_, F.col("weight"))).alias("w"), F.sum(F.when(~open_, most)).alias("full")).first()
        if row["n"] == total or not row["n"]:
            break
        total, left, unit = row["n"], share * words - (row["full"] or 0.0), row["w"]
        open_ = F.lit(left) * F.col("weight") / F.lit(unit) <= most
    share_of = F.lit(left) * F.col("weight") / F.lit(unit) if total else F.lit(0.0)
    return sources.select("source_key", "source_size", F.least(share_of, most).cast("double").alias("target"))


def fit_lengths(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the words come as near to
    ``budget`` as they can without passing it: an even share of each length,
    then the largest that fit, then a bounded knapsack over the last words."""
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget >= total:
        return list(counts)
    take = [c * budget // total if total else 0 for c in counts]
    left = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in order:
        if left <= KNAPSACK_WORDS:
            break
        if lengths[i]:
            more = min(counts[i] - take[i], (left - KNAPSACK_WORDS // 2) // lengths[i])
            if more > 0:
                take[i] += more
                left -= more * lengths[i]
    while left > KNAPSACK_WORDS:
        # what is still to be had is longer than half of what is left: the longest that fits, one at a time
        fits = next((i for i in order if 0 < lengths[i] <= left and take[i] < counts[i]), None)
        if fits is None:
            return take
        take[fits] += 1
        left -= lengths[fits]
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order[::-1]:  # short lengths make most sums
        spare = min(counts[i] - take[i], left // lengths[i] if lengths[i] else 0)
        part = 1
        while spare > 0 and not reach >> left & 1:
            k = min(part, spare)
            grown = (reach | reach << k * lengths[i]) & mask
            if grown != reach:
                steps.append((i, k, reach))
                reach = grown
            spare -= k
            part *= 2
    at = reach.bit_length() - 1
    for i, k, before in reversed(steps):
        if not before >> at & 1:
            take[i] += k
            at -= k * lengths[i]
    return take


def _nearest(lengths: list[int], counts: list[int], take: list[int], budget: int) -> list[int]:
    """``take``, or with one document more where that passes the budget by less than it now misses."""
    missed = budget - sum(n * k for n, k in zip(lengths, take, strict=True))
    fits = [(n, i) for i, n in enumerate(lengths) if take[i] < counts[i] and missed < n < 2 * missed]
    if fits:
        take = list(take)
        take[min(fits)[1]] += 1
    return take


def _choose(cap: float, group: pd.DataFrame) -> pd.DataFrame:
    """For one source: per length, passes that all its documents make and how many make one more."""
    group = group.sort_values("size")
    lengths, counts = group["size"].tolist(), group["n"].tolist()
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    target = round(float(group["target"].iloc[0]))
    passes = min(target // whole, int(cap)) if whole else 0
    budget = max(0, target - passes * whole)
    more = _nearest(lengths, counts, fit_lengths(lengths, counts, budget), budget) if passes < cap else [0] * len(lengths)
    return group.assign(passes=passes, more=more)[["source_key", "size", "n", "passes", "more"]].astype({"passes": "int64", "more": "int64"})


def _sized(docs: DataFrame, seed: int, *more: str) -> DataFrame:
    """Size, hash and null-free source key of each row, beside the columns asked for."""
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    return docs.select(*more, word_count(F.col("text")).alias("size"), draw.alias("draw"), F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source_key"))


def _choice(sized: DataFrame, weights, share: float, cap: float) -> DataFrame:
    """(source_key, size, source_size, target, passes, cut, at_cut, ties): documents whose hash
    is below ``cut``, and ``at_cut`` of the ``ties`` that have it, make one more pass; null: none does."""
    cell = ["source_key", "size"]
    counts = stage(sized.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")), "lengths")
    goal = stage(source_targets(counts, weights, share, cap), "goals")
    if goal.count() <= BROADCAST_CELLS:
        goal = F.broadcast(goal)
    plan = stage(counts.join(goal, "source_key").groupBy("source_key").applyInPandas(lambda g: _choose(cap, g), "source_key string, size long, n long, passes long, more long"), "choice")
    part = plan.where("more > 0 and more < n").select(*cell, "more")
    # the bucket, by leading bits of the hash, in which the choice of a length ends, and how many of it are chosen
    bucketed = sized.select(*cell, "draw", F.shiftright("draw", 64 - BUCKET_BITS).alias("bucket"))
    upto = F.sum("k").over(Window.partitionBy(*cell).orderBy("bucket"))
    ends = bucketed.groupBy(*cell, "bucket").agg(F.count(F.lit(1)).alias("k")).join(part, cell).withColumn("upto", upto)
    ends = ends.where("upto >= more and upto - k < more").select(*cell, "bucket", (F.col("more") - F.col("upto") + F.col("k")).alias("left"))
    nth = F.row_number().over(Window.partitionBy(*cell).orderBy("draw"))
    before = F.rank().over(Window.partitionBy(*cell).orderBy("draw")) - 1
    ranked = bucketed.join(ends, [*cell, "bucket"]).withColumns({"nth": nth, "before": before, "ties": F.count(F.lit(1)).over(Window.partitionBy(*cell, "draw"))})
    cuts = ranked.where("nth = left").select(*cell, F.col("draw").alias("found"), (F.col("nth") - F.col("before")).alias("at_cut"), "ties")
    cut = F.when(F.col("more") == F.col("n"), F.lit((1 << 63) - 1)).otherwise(F.col("found"))
    return stage(plan.join(cuts, cell, "left").join(goal, "source_key").select(*cell, "source_size", "target", "passes", cut.alias("cut"), "at_cut", "ties"), "cuts")


def _with_copies(sized: DataFrame, choice: DataFrame) -> DataFrame:
    shared = choice.where("at_cut < ties").limit(1).count() > 0
    if choice.count() <= BROADCAST_CELLS:
        choice = F.broadcast(choice)
    joined = sized.join(choice, ["source_key", "size"]).withColumn("chosen", F.coalesce(F.col("draw") <= F.col("cut"), F.lit(False)))
    if shared:
        tied = F.coalesce((F.col("draw") == F.col("cut")) & (F.col("at_cut") < F.col("ties")), F.lit(False))
        nth = F.row_number().over(Window.partitionBy("source_key", "size").orderBy("tie"))
        joined = joined.where(~tied).unionByName(joined.where(tied).withColumn("chosen", nth <= F.col("at_cut")))
    copies = F.col("passes") + F.col("chosen").cast("long")
    # a document without words stays once: it costs nothing
    return joined.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(1)).cast("int"))


def _tie(docs: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, MapType)])


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (passes the document makes), taken."""
    sized = stage(_sized(docs.select("doc_id", "text", "source", _tie(docs).alias("tie")), seed, "doc_id", "source", "tie"), "sized")
    out = _with_copies(sized, _choice(sized, weights, share, cap))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source, ...) as often as the mix takes them."""
    choice = _choice(stage(_sized(docs, seed), "sized"), weights, share, cap)
    rows = _with_copies(_sized(docs.select("doc_id", "text", "source", F.struct("*").alias("row"), _tie(docs).alias("tie")), seed, "row", "tie"), choice).where("copies > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
