"""Mixing sources to target weights by temperature.

A source's weight is its token share to the power of an exponent, normalised: 1 keeps the natural mixture, 0 makes all sources
equal. The exponent is bisected, in [0, 1], until the mixture's entropy reaches a target, or as low as a limit on how often any
source is repeated allows. With the budget (all sources' tokens together, or as many as it takes to read every source once in
full, which is the default and leaves no document out) each weight gives a source a number of passes, whole ones and a last,
partial one.

Passes are realised as block permutations: a source's documents are dealt by hash to blocks of about block_docs documents; in
each pass the blocks, and the documents in a block, stand in an order drawn by hash anew. The last pass takes blocks in that
order up to its budget of tokens, and of the block where it ends the documents up to it. As the order is a pair of hashes, that
end is one pair for each source, found from sums of blocks and the documents of one block; texts are never shuffled.

Only sums over sources reach the driver, for 64 exponents at a time: four rounds narrow the bracket to 1e-7. The table of
sources is broadcast only if Spark knows it to be small.

Cases: null is a source of its own. Sources without tokens pass once. Null text has 0 tokens. Ties in an order go by key.
Repeated rows are counted, and pass, each. An empty table gives none. All columns of the input are kept; the operator's own
columns are named by a prefix that is a parameter, so names needn't clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm.common import stash
from gleanery.llm.packing import words

_GRID = 64


def exponent(shares: DataFrame, target_entropy: float | None = None, max_repeat: float | None = None, budget_share: float | None = None) -> float:
    """The exponent for sources' shares (column p, above 0). budget_share: the budget over all tokens; None: every source once in full."""
    lo, hi = 0.0, 1.0
    for _ in range(4):
        grid = [lo + (hi - lo) * i / _GRID for i in range(_GRID + 1)]
        p = F.col("p")
        ask = [x for i, a in enumerate(grid) for x in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{i}"))]
        r = shares.agg(F.max(p).alias("most"), F.min(p).alias("least"), *ask).first()
        if r["most"] is None:
            return 1.0

        def enough(i: int) -> bool:
            """Whether the exponent is high enough; holds at 1."""
            a, z = grid[i], r[f"z{i}"]
            if target_entropy is not None:
                return math.log(z) - a * r[f"l{i}"] / z <= target_entropy
            rate = r["least"] ** (a - 1) / (r["most"] ** (a - 1) if budget_share is None else z / budget_share)
            return rate <= max_repeat

        first = next((i for i in range(_GRID + 1) if enough(i)), _GRID)
        if first == 0:
            return grid[0]
        lo, hi = grid[first - 1], grid[first]
    return hi


def mixture(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text", tokens: Column | None = None, target_entropy: float | None = None, max_repeat: float | None = 2.0, budget_share: float | None = None, block_docs: int = 4096, seed: int = 1, prefix: str = "mix_") -> DataFrame:
    """The rows of docs as often as the mixture has them, with columns epoch, block, block_key, doc_key (the order in an epoch), n_tokens and weight, each named with prefix."""
    n = F.coalesce((words(text) if tokens is None else tokens).cast("bigint"), F.lit(0).cast("bigint"))
    narrow = docs.select(F.col(f"`{source}`").alias("s"), F.col(f"`{key}`").alias("k"), n.alias("n"))
    totals = stash(narrow.groupBy("s").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("docs")))
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.where("tokens > 0").select("s", (F.col("tokens") / F.lit(float(whole or 1))).alias("p"))
    a = exponent(shares, target_entropy, max_repeat, budget_share)
    z, most = shares.agg(F.sum(F.pow("p", F.lit(a))), F.max("p")).first()
    # passes = weight * budget / tokens = p^(a-1) * budget_share / z; by default the scale at which the largest source passes once
    scale = (most ** (1 - a) if budget_share is None else budget_share / z) if most else 1.0
    p = F.col("tokens") / F.lit(float(whole or 1))
    passes = F.when(F.col("tokens") > 0, F.greatest(F.pow(p, F.lit(a - 1)) * F.lit(scale), F.lit(1.0) if budget_share is None else F.lit(0.0))).otherwise(1.0)
    plan = totals.select("s", "tokens", F.ceil(F.col("docs") / block_docs).cast("bigint").alias("blocks"), passes.alias("passes"), F.when(F.col("tokens") > 0, F.pow(p, F.lit(a)) / F.lit(float(z or 1))).otherwise(0.0).alias("weight"))
    plan = plan.withColumn("full", F.floor("passes").cast("int")).withColumn("rest", F.round((F.col("passes") - F.col("full")) * F.col("tokens")).cast("bigint"))

    def block(row_key: Column, blocks: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), row_key.cast("string")), blocks)

    def block_key(s: Column, epoch: Column, b: Column) -> Column:
        return F.xxhash64(F.lit(seed + 1), s, epoch, b)

    def doc_key(epoch: Column, row_key: Column) -> Column:
        return F.xxhash64(F.lit(seed + 2), epoch, row_key.cast("string"))

    same = F.col("s").eqNullSafe(F.col("ps"))
    of = narrow.join(plan.select(F.col("s").alias("ps"), "blocks", "full", "rest").where("rest > 0"), same).withColumn("b", block(F.col("k"), F.col("blocks")))
    sums = of.groupBy("s", "full", "rest", "b").agg(F.sum("n").alias("n")).withColumn("bk", block_key(F.col("s"), F.col("full"), F.col("b")))
    sums = sums.withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("bk", "b")))
    end = stash(sums.where("upto > rest and upto - n <= rest").select(F.col("s").alias("ps"), F.col("b").alias("eb"), F.col("bk").alias("ebk"), "full", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")))
    # documents of the block at which a source's last pass ends: about block_docs a source
    last = narrow.join(plan.select(F.col("s").alias("ps"), "blocks"), same).withColumn("b", block(F.col("k"), F.col("blocks"))).drop("ps", "blocks")
    last = last.join(end, same & (F.col("b") == F.col("eb"))).withColumn("dk", doc_key(F.col("full"), F.col("k")))
    last = last.groupBy("s", "dk", "room").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(Window.partitionBy("s").orderBy("dk")))
    final = last.where("upto <= room").groupBy("s").agg(F.max("dk").alias("edk"))
    end = end.select("ps", "ebk").join(final, F.col("s").eqNullSafe(F.col("ps")), "left").select(F.col("ps").alias("es"), "ebk", "edk")
    plan = stash(plan.join(end, F.col("s").eqNullSafe(F.col("es")), "left").select(F.col("s").alias("__s"), *(F.col(c).alias(f"__{c}") for c in ("blocks", "full", "rest", "weight", "ebk", "edk"))))

    out = docs.withColumn(f"{prefix}n_tokens", n).join(plan, F.col(f"`{source}`").eqNullSafe(F.col("__s")))
    out = out.withColumn(f"{prefix}block", block(F.col(f"`{key}`"), F.col("__blocks")))
    bk, dk = block_key(F.col("__s"), F.col("__full"), F.col(f"{prefix}block")), doc_key(F.col("__full"), F.col(f"`{key}`"))
    # without an end, a rest takes in the whole source (it can, by rounding, be all of its tokens)
    again = (F.col("__rest") > 0) & (F.col("__ebk").isNull() | (bk < F.col("__ebk")) | ((bk == F.col("__ebk")) & F.coalesce(dk <= F.col("__edk"), F.lit(False))))
    times = F.col("__full") + again.cast("int")
    out = out.where(times > 0).withColumn(f"{prefix}epoch", F.explode(F.sequence(F.lit(0), times - 1)))
    out = out.withColumn(f"{prefix}block_key", block_key(F.col("__s"), F.col(f"{prefix}epoch"), F.col(f"{prefix}block"))).withColumn(f"{prefix}doc_key", doc_key(F.col(f"{prefix}epoch"), F.col(f"`{key}`"))).withColumn(f"{prefix}weight", F.col("__weight"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[f"{prefix}{c}" for c in ("epoch", "block", "block_key", "doc_key", "n_tokens", "weight")])
