"""Mixing sources to target weights by temperature.

A source's share of the tokens is raised to an exponent and normalised: 1 keeps the shares, 0
makes all sources equal, above 1 large sources gain. The exponent is bisected until the mix meets
a target entropy, or until the source that repeats most is read `max_repeats` times; sums over sources at PARTS
exponents are taken in one Spark aggregation and the bracket shrinks by that factor, so that
only those sums reach the driver, however many sources there are.

The weights are realised by budgeted block permutations: a source's documents are hashed into
blocks of about BLOCK_TOKENS tokens, permuted by a keyed hash within their block, anew for each
epoch, and each block gives its part of the source's budget: whole epochs of all its documents
and then the documents at the head of its permutation. A hot source has many blocks.

Without a budget of tokens, the budget is such that the source with the least weight for its
size is read exactly once: no document is dropped. A null source is a source of its own.
A document counts its words and an end token, so null and empty texts count one, and the longest
text is one draw. Repeated rows are drawn each by itself, ties in their order broken by doc_id and a
hash of the text; a null doc_id is drawn like any other. An empty table gives no draws. Extra
columns, whatever their names, are kept by `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.common import written

PARTS = 64
BLOCK_TOKENS = 1 << 18
TOLERANCE = 1e-9
#: Exponents above one that are tried; the weights of all but the largest sources are then below any count of tokens.
HIGHEST = 1024.0


def tokens_of(text) -> F.Column:
    """Words between ASCII white space, and an end token."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long") + 1


def source_key(source) -> F.Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def bisect(sources: DataFrame, reached, low: float = 0.0, high: float = 1.0, highest: float = 1.0) -> float:
    """Smallest exponent at which reached(sums) holds, where it holds from there on.

    sources: (r), shares by the largest share. sums of an exponent a: z = sum r^a, s = sum r^a ln r,
    and the smallest r. `high` doubles up to `highest`; if even that does not do, there is none.
    """
    while True:
        grid = [low + (high - low) * i / PARTS for i in range(PARTS + 1)]
        power = [F.pow("r", F.lit(a)) for a in grid]
        row = sources.agg(F.min("r").alias("least"), *(F.sum(x).alias(f"z{i}") for i, x in enumerate(power)), *(F.sum(x * F.ln("r")).alias(f"s{i}") for i, x in enumerate(power))).first()
        first = next((i for i, a in enumerate(grid) if reached(a, row[f"z{i}"], row[f"s{i}"], row["least"])), None)
        if first is None:
            if high >= highest:
                raise ValueError("no exponent meets the target")
            low, high = high, min(2 * high, highest)
        elif first == 0 or high - low <= TOLERANCE * max(1.0, high):
            return grid[first]
        else:
            low, high = grid[first - 1], grid[first]


def weights(documents: DataFrame, target_entropy: float | None = None, max_repeats: float | None = 2.0, budget: float | None = None) -> DataFrame:
    """documents: (src, n_tokens). src, tokens, share, exponent, weight, epochs of every source.

    target_entropy is in bits; it may lie below that of the shares, which takes an exponent above 1.
    With a budget, repeats are those of the budget. A target that no exponent meets is an error.
    """
    from math import log

    sizes = written(documents.groupBy("src").agg(F.sum("n_tokens").alias("tokens")))
    row = sizes.agg(F.sum("tokens").alias("t"), F.max("tokens").alias("m")).first()
    total, most = row["t"], row["m"]
    if not total:
        return sizes.select("src", "tokens", *(F.lit(1.0).alias(c) for c in ("share", "exponent", "weight", "epochs")))
    shares = sizes.withColumn("r", F.col("tokens") / F.lit(float(most)))

    def repeats(a, z, least):
        """Epochs of the source that repeats most: the smallest for a < 1, the largest for a > 1."""
        if budget is None:
            return least ** (a - 1)
        return max(1.0, least ** (a - 1)) / z * budget / most

    def reached(a, z, s, least):
        if target_entropy is not None:
            return (log(z) - a * s / z) / log(2) <= target_entropy + TOLERANCE
        return repeats(a, z, least) <= max_repeats * (1 + TOLERANCE)

    if target_entropy is not None and (log(sizes.count()) / log(2) if target_entropy > 0 else 0) < target_entropy - TOLERANCE:
        raise ValueError("no mix of these sources has so much entropy")
    # Beyond 1 repeats only grow; entropy falls to that of the largest sources alone.
    exponent = bisect(shares, reached, highest=HIGHEST if target_entropy is not None else 1.0)
    z = shares.agg(F.sum(F.pow("r", F.lit(exponent))).alias("z")).first()["z"]
    weight = F.pow("r", F.lit(exponent)) / F.lit(z)
    # Without a budget nothing is dropped: the source with the fewest epochs is read once. Epochs go
    # as r ^ (exponent - 1), which falls with the share below 1 and grows with it above.
    fewest = 1.0 if exponent <= 1 else shares.agg(F.min("r").alias("r")).first()["r"] ** (exponent - 1)
    tokens = budget if budget is not None else most * z / fewest
    return shares.select("src", "tokens", (F.col("tokens") / F.lit(float(total))).alias("share"), F.lit(exponent).alias("exponent"), weight.alias("weight"), (weight * F.lit(float(tokens)) / F.col("tokens")).alias("epochs"))


def draws(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", key: str = "quillmesh", keep: bool = False, **target) -> DataFrame:
    """src, doc_id, n_tokens, epoch, block, rank of every draw; keep: with the row of docs as `row`."""
    row = [F.struct("*").alias("row")] if keep else []
    counted = docs.select(F.col(doc_id).alias("doc_id"), source_key(F.col(source)).alias("src"), tokens_of(F.col(text)).alias("n_tokens"), F.xxhash64(F.col(text)).alias("tie"), *row)
    plan = weights(counted.select("src", "n_tokens"), **target)
    n_blocks = F.greatest(F.ceil(F.col("tokens") / F.lit(BLOCK_TOKENS)), F.lit(1))
    # 1e-9: the largest source's epochs are 1 but for rounding.
    epochs = F.col("epochs") + 1e-9
    placed = counted.join(plan.select("src", epochs.alias("epochs"), n_blocks.alias("n_blocks")), "src").withColumn("block", F.pmod(F.xxhash64(F.lit(key), "src", "doc_id", "tie"), F.col("n_blocks")).cast("int"))
    whole = F.floor("epochs").cast("int")
    order = Window.partitionBy("src", "block").orderBy(F.xxhash64(F.lit(key), whole, "doc_id", "tie"), "doc_id", "tie")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens") / 2
    budget = F.sum("n_tokens").over(Window.partitionBy("src", "block")) * (F.col("epochs") - whole)
    times = placed.withColumn("times", whole + F.when(before <= budget, 1).otherwise(0))
    drawn = times.where("times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    rank = F.xxhash64(F.lit(key), "epoch", "doc_id", "tie")
    return drawn.select("src", "doc_id", "n_tokens", "epoch", "block", rank.alias("rank"), *(["row"] if keep else []))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **target) -> DataFrame:
    """The rows of docs, each as often as it is drawn, with all their columns, in the order of the draws' ranks.

    Written to files, the rows stand in that order from file to file.
    """
    return draws(docs, doc_id, text, source, keep=True, **target).repartitionByRange("rank").sortWithinPartitions("rank", "doc_id", "epoch").select("row.*")
