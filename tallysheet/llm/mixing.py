"""Mixing sources to target weights: temperature mixing.

The weight of a source is its share of all tokens to the power ``alpha``, normalised. alpha
between 0 (all sources alike) and 1 (as they are) is the largest one that meets the target:
an entropy of the weights of at least ``min_entropy`` (as a share of the highest possible
one), and no source repeated more than ``max_repeat`` times within the budget. Both go one
way in alpha, so alpha is found by bisection; each pass over the table of sources tries
SECTION exponents at once and keeps the interval between two of them. If even alpha = 1
repeats no source more often and its entropy suffices, it stays 1; the repetition limit
goes before the entropy.

The weights are realised in whole documents. A source with weight w gets w * budget tokens:
as many whole epochs as fit, and from one more epoch the first documents, in an order by
hash, up to and with the one that reaches the budget. An epoch is a sequence of blocks of
about BLOCK documents, each in an order of its own by hash, so no source is sorted or
summed in one task: the cut of the last epoch is found from sums of blocks, and then in the
one block that holds it. Documents only meet the table of sources.

Defined results: null sources are a source of their own; null and empty texts have no
tokens, are in every whole epoch and in the part before the cut; a source without tokens
gets one epoch; repeated rows are taken each on their own: if the cut falls among rows of equal
id and text, as many of them are taken as the budget needs; a column named as the new one is
replaced. Empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallysheet.session import stage

MIN_ENTROPY = 0.97
MAX_REPEAT = 4.0
BLOCK = 4096
SECTION = 32
PASSES = 6


def tokens(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def solve_alpha(sources: DataFrame, budget: float, total: float, n_sources: int, min_entropy: float, max_repeat: float) -> float:
    """Largest exponent in [0, 1] that meets the targets. sources: n_tokens > 0."""
    import math

    low, high = 0.0, 1.0
    for i in range(PASSES):
        steps = [low + (high - low) * k / SECTION for k in range(SECTION + 1)]
        share = F.col("n_tokens") / F.lit(total)
        power = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("alpha")) for k, a in enumerate(steps)])).alias("try")
        tried = sources.select(share.alias("p"), power).withColumn("w", F.pow("p", F.col("try.alpha")))
        rows = tried.groupBy("try.k").agg(
            F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("wlogw"), F.max(F.col("w") / F.col("p")).alias("most"),
        ).collect()
        good = -1
        for r in sorted(rows, key=lambda r: r["k"]):
            entropy = math.log(r["z"]) - r["wlogw"] / r["z"]
            repeat = r["most"] / r["z"] * budget / total
            # flatter weights have more entropy and repeat small sources more
            if repeat > max_repeat * (1 + 1e-12) or entropy >= min_entropy * math.log(max(2, n_sources)):
                good = r["k"]
        if good < 0:
            return 0.0 if i == 0 else low
        if good == SECTION:
            return steps[-1]
        low, high = steps[good], steps[good + 1]
    return low


def plan(measured: DataFrame, budget: int | None = None, min_entropy: float = MIN_ENTROPY, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Columns source, n_docs, n_tokens, weight, epochs, rest, alpha: whole epochs and the tokens of one more."""
    sources = stage(measured.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")))
    some = sources.filter("n_tokens > 0")
    whole = some.agg(F.sum("n_tokens").alias("total"), F.count("*").alias("n")).head()
    total = whole["total"] or 0
    wanted = total if budget is None else budget
    alpha = solve_alpha(some, float(wanted), float(total), whole["n"], min_entropy, max_repeat) if total else 1.0
    power = F.when(F.col("n_tokens") > 0, F.pow(F.col("n_tokens") / F.lit(float(max(1, total))), F.lit(alpha))).otherwise(0.0)
    norm = sources.agg(F.sum(power)).head()[0] or 1.0
    aim = F.floor(power / F.lit(norm) * F.lit(float(wanted)) + 0.5)
    return sources.select(
        "source", "n_docs", "n_tokens", (power / F.lit(norm)).alias("weight"), F.lit(alpha).alias("alpha"),
        F.when(F.col("n_tokens") > 0, F.floor(aim / F.col("n_tokens"))).otherwise(1).cast("bigint").alias("epochs"),
        F.when(F.col("n_tokens") > 0, aim % F.col("n_tokens")).otherwise(0).cast("bigint").alias("rest"),
    )


def order_of(uid: Column, epoch: Column | int, seed: int) -> Column:
    """Place of a document in an epoch: the top bits choose its block, all bits its place there."""
    return F.xxhash64(uid, F.lit(epoch) if isinstance(epoch, int) else epoch, F.lit(seed))


def block_of(place: Column, n_docs: Column) -> Column:
    blocks = F.ceil(n_docs / BLOCK)
    return F.floor((place / F.lit(2.0**64) + 0.5) * blocks).cast("bigint")


def cuts(measured: DataFrame, planned: DataFrame, seed: int) -> DataFrame:
    """Per source with a rest: the place of the last document taken from the epoch after the whole ones,
    and how many of the equal rows at that place are taken."""
    open_sources = planned.filter("rest > 0").select(F.col("source").alias("s"), "n_docs", "epochs", "rest")
    placed = measured.join(open_sources, F.col("source").eqNullSafe(F.col("s"))).withColumn("place", order_of(F.col("uid"), F.col("epochs"), seed))
    placed = placed.withColumn("block", block_of(F.col("place"), F.col("n_docs")))
    blocks = placed.groupBy("s", "rest", "block").agg(F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.partitionBy("s").orderBy("block")) - F.col("n_tokens")
    held = blocks.withColumn("before", before).filter("before < rest and before + n_tokens >= rest").select(F.col("s").alias("cut_s"), F.col("block").alias("cut_block"), "before")
    inside = placed.join(held, F.col("s").eqNullSafe(F.col("cut_s")) & (F.col("block") == F.col("cut_block")))
    places = inside.groupBy("s", "rest", "before", "place").agg(F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("each"))
    earlier = F.sum("n_tokens").over(Window.partitionBy("s").orderBy("place")) - F.col("n_tokens") + F.col("before")
    reached = places.withColumn("left", F.col("rest") - earlier).filter("left > 0 and left <= n_tokens")
    return reached.select("s", F.col("place").alias("cut"), F.ceil(F.col("left") / F.col("each")).alias("cut_rows"))


def first_rows(equal: DataFrame) -> DataFrame:
    """Of the rows at the cut of a source the first ``cut_rows``, numbered within partitions and by sums over these."""
    held = stage(equal.withColumn("part", F.spark_partition_id()))
    counts = held.groupBy(F.col("s").alias("part_s"), F.col("part").alias("part_no")).agg(F.count("*").alias("rows"))
    skipped = F.sum("rows").over(Window.partitionBy("part_s").orderBy("part_no")) - F.col("rows")
    met = held.join(counts.withColumn("skipped", skipped), F.col("s").eqNullSafe(F.col("part_s")) & (F.col("part") == F.col("part_no")))
    number = F.row_number().over(Window.partitionBy("s", "part").orderBy(F.lit(1))) + F.col("skipped")
    return met.withColumn("number", number).filter("number <= cut_rows")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", budget: int | None = None, min_entropy: float = MIN_ENTROPY, max_repeat: float = MAX_REPEAT, seed: int = 0, mix_col: str = "mix") -> DataFrame:
    """docs once per epoch in which they are taken, with the new column mix_col (epoch, block, place, weight, alpha).

    Ordered by mix within a source the rows are its permutations; budget: tokens, the
    corpus's own number if None.
    """
    uid = F.xxhash64(docs[id_col], docs[text_col])
    measured = stage(docs.select(docs[source_col].alias("source"), uid.alias("uid"), tokens(docs[text_col]).alias("n_tokens")))
    planned = stage(plan(measured, budget, min_entropy, max_repeat))
    cut = cuts(measured, planned, seed)
    table = stage(
        planned.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
        .select(F.col("source").alias("s"), "n_docs", "epochs", "cut", "cut_rows", "weight", "alpha")
    )
    rows = docs.select(F.struct(*docs.columns).alias("row"), uid.alias("uid"), docs[source_col].alias("own"))
    met = rows.join(table, F.col("own").eqNullSafe(F.col("s"))).drop("own")
    last = order_of(F.col("uid"), F.col("epochs"), seed)
    more = F.coalesce(last < F.col("cut"), F.lit(False))
    times = F.col("epochs") + more.cast("bigint")
    whole = met.filter(times > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)))
    at_cut = first_rows(met.filter(last == F.col("cut"))).withColumn("epoch", F.col("epochs"))
    taken = whole.unionByName(at_cut.select(*whole.columns))
    place = order_of(F.col("uid"), F.col("epoch"), seed)
    mix = F.struct("epoch", block_of(place, F.col("n_docs")).alias("block"), place.alias("place"), "weight", "alpha")
    return taken.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != mix_col], mix.alias(mix_col))
