"""Temperature mixing of sources.

A source with share p of all tokens gets the weight p**a / sum(p**a). The exponent a between 0 (all alike) and 1 (as
found) is bisected: the largest one whose weights have the wanted entropy, but no smaller than the one at which no
source is repeated more often than the limit. The budget of tokens then gives each source a number of epochs,
budget * weight / tokens. Every whole epoch draws all of the source's documents once, the last part of one draws
those that fit, each epoch in a permutation of its own. The draws of a source are spread evenly over the blocks of
the training stream, so that each block holds the mixture.

Positions in a permutation are running sums of tokens in the order of a hash. They are computed over slots of about
SLOT_ROWS documents, over spans of SLOT_ROWS slots, and then within slots. The plan of a few sources is broadcast, so
rows are dealt by (source, epoch, slot) and no source is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from math import exp, log

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLOT_ROWS = 1_000
#: Sources whose totals the driver holds; of more, each step of the bisection is an aggregation.
DRIVER_SOURCES = 10_000
STEPS = 50


def _bisect(holds: Callable[[float], bool]) -> float:
    """The largest exponent in [0, 1] for which holds() is true, if it is true up to there; 0 if never."""
    if holds(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (middle, high) if holds(middle) else (low, middle)
    return low


def temperature(totals: DataFrame, entropy_share: float, most_epochs: float, budget_share: float = 1.0) -> float:
    """The exponent for totals(source, tokens)."""
    total, count = totals.agg(F.sum("tokens"), F.count("*")).first()
    if not total or count < 2:
        return 1.0
    wanted = entropy_share * log(count)
    if count <= DRIVER_SOURCES:
        shares = sorted(r["tokens"] / total for r in totals.collect())

        def measures(a: float) -> tuple[float, float]:
            raw = [exp(a * log(p)) for p in shares]
            scale = sum(raw)
            return -sum(w / scale * log(w / scale) for w in raw), budget_share * max(w / scale / p for w, p in zip(raw, shares, strict=True))
    else:

        def measures(a: float) -> tuple[float, float]:
            p = F.col("tokens") / F.lit(total)
            raw = F.exp(F.lit(a) * F.log(p))
            scale, weighted, most = totals.agg(F.sum(raw), F.sum(raw * F.log(raw)), F.max(raw / p)).first()
            return log(scale) - weighted / scale, budget_share * most / scale

    by_entropy = _bisect(lambda a: measures(a)[0] >= wanted)
    # repeats fall as the exponent rises to 1, where each source has budget_share epochs
    if measures(by_entropy)[1] <= most_epochs:
        return by_entropy
    return 1.0 - _bisect(lambda b: measures(1.0 - b)[1] <= most_epochs)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    entropy_share: float = 0.95,
    most_epochs: float = 4.0,
    budget_share: float = 1.0,
    block_tokens: int = 1_000_000,
    seed: str = "mix",
) -> DataFrame:
    """The draws: (id, source, n_tokens, epoch int, block long), one row for each time a document is used.

    Tokens are a quarter of the UTF-8 bytes, rounded up, 1 at least. entropy_share is the wanted entropy as a share of
    that of equal weights; budget_share the budget as a share of all tokens. Null and empty sources are one source,
    ''. Rows with the same id (null included) are one document with their tokens together and the smallest source.
    """
    size = F.greatest(F.lit(1), F.ceil(F.coalesce(F.octet_length(text_col), F.lit(0)) / 4)).cast("long")
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), size.alias("n"))
    base = base.groupBy("id").agg(F.min("source").alias("source"), F.sum("n").alias("n_tokens"))
    totals = base.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    exponent = temperature(totals.select("source", "tokens"), entropy_share, most_epochs, budget_share)
    budget, scale = totals.agg(F.sum("tokens") * F.lit(budget_share), F.sum(F.pow(F.col("tokens") / F.lit(1.0), F.lit(exponent)))).first()
    blocks = max(1, round((budget or 0) / block_tokens))
    # drawn: tokens of the source in the stream; a part of a token doesn't count
    drawn = F.floor(F.lit(budget) * F.pow(F.col("tokens") / F.lit(1.0), F.lit(exponent)) / F.lit(scale) + F.lit(1e-6)) if budget else F.lit(0)
    plan = totals.select("source", "tokens", drawn.cast("long").alias("drawn"), F.ceil(F.col("docs") / SLOT_ROWS).cast("long").alias("slots"))
    if totals.limit(DRIVER_SOURCES + 1).count() <= DRIVER_SOURCES:
        plan = F.broadcast(plan)  # a row for each source
    draws = base.join(plan, "source").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("drawn") - 1) / F.col("tokens")).cast("int"))))
    draws = draws.where("drawn > 0").withColumn("key", F.md5(F.concat_ws("/", F.lit(seed), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    draws = draws.withColumn("slot", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("slots") / F.lit(1 << 32)).cast("long"))
    draws = draws.withColumn("span", F.floor(F.col("slot") / SLOT_ROWS).cast("long"))
    part, where = ["source", "epoch", "span"], ["source", "epoch", "span", "slot"]
    slots = draws.groupBy(*where).agg(F.sum("n_tokens").alias("held"))
    ahead = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = slots.groupBy(*part).agg(F.sum("held").alias("held"))
    spans = spans.select(*part, F.coalesce(F.sum("held").over(ahead(*part)), F.lit(0)).alias("before"))
    sums = slots.join(spans, part).select(*where, (F.col("before") + F.coalesce(F.sum("held").over(ahead(*where)), F.lit(0))).alias("ahead"))
    inside = Window.partitionBy(*where).orderBy("key", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = draws.join(sums, where).withColumn("upto", F.col("epoch") * F.col("tokens") + F.col("ahead") + F.sum("n_tokens").over(inside))
    kept = placed.where("upto <= drawn")
    block = F.floor((F.col("upto") - F.col("n_tokens")) * F.lit(blocks) / F.col("drawn")).cast("long")
    return kept.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "n_tokens", "epoch", block.alias("block"))
