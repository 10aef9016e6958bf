"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, same, seeded_unit

MAX_EPOCHS = 4.0
SEED = 17
#: The table of sources is broadcast up to this many bytes.
BROADCAST_BYTES = 64 << 20


def source_epochs(docs: DataFrame, weights: Mapping[str, float] | None = None, *, source: str = "source", text: str = "text", budget: float | None = None, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row for each source: (source, size, weight, alloc, epochs).

    size is the UTF-8 bytes of its texts.  The budget (default: all bytes, so
    that the mixture is as large as the corpus) is shared in proportion to
    `weights` (default: equal).  A source that would be repeated more than
    `max_epochs` times is clamped there and what it leaves is shared again in
    proportion among the rest, until no source exceeds its cap; if all are
    clamped, the mixture is smaller than the budget.  The water level is found
    in one pass: in order of cap / weight the clamped sources come first.

    Null is a source of its own.  Sources without a weight (weight 0 or absent
    from `weights`) and sources without text get no share.  Ties in cap /
    weight are clamped together or not at all, whatever their order.
    """
    if max_epochs < 0 or weights is not None and any(w < 0 for w in weights.values()):
        raise ValueError("weights and max_epochs can't be negative")
    sizes = docs.select(F.col(source).alias("source"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n")).groupBy("source").agg(F.sum("n").alias("size"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        known = F.lit(None).cast("double")
        for k, w in weights.items():
            known = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(w))).otherwise(known)
        weighted = sizes.withColumn("weight", F.coalesce(known, F.lit(0.0)))
    live = weighted.withColumn("w", F.when(F.col("size") > 0, F.col("weight")).otherwise(0.0)).withColumn("cap", F.col("size") * F.lit(float(max_epochs)))
    # One row per source: windows over all of them stay small however large the corpus is.
    everything = W.partitionBy(F.lit(0))
    order = everything.orderBy((F.col("cap") / F.nullif(F.col("w"), F.lit(0.0))).asc_nulls_last(), F.col("source").asc_nulls_first())
    total = F.sum("size").over(everything).cast("double") if budget is None else F.lit(float(budget))
    filled = (
        live.withColumn("total", total)
        .withColumn("left", F.col("total") - F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("cap")).otherwise(0.0)).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
        .withColumn("level", F.when(F.col("w") > 0, F.col("left") / F.col("w_left")))
        .withColumn("place", F.row_number().over(order))
    )
    # The first source whose cap isn't exceeded at its own level sets the level of all after it.
    level = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("place"), F.col("level")))).over(everything)["level"]
    alloc = F.when(F.col("w") > 0, F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))).otherwise(0.0)
    return filled.withColumn("alloc", alloc).select("source", "size", "weight", "alloc", F.when(F.col("size") > 0, F.col("alloc") / F.col("size")).otherwise(0.0).alias("epochs"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", budget: float | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """Rows of `docs`, each as often as its source's epochs say.

    A source with 2.3 epochs has each document twice, and a third time where
    the seeded hash of its id is below 0.3.  Repeated rows and equal or null
    ids are decided alike, each row by its own id.  Other columns pass through
    unchanged, whatever their names; `copy` names an optional column that
    numbers the repetitions from 0, and replaces one of that name, in any
    case.  An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    e = source_epochs(docs, weights, source=source, text=text, budget=budget, max_epochs=max_epochs).select(F.col("source").alias("s"), F.col("epochs").alias("e"))
    e = scratch.save(e)
    # a row for each source: sent to the rows while that is small, so that no text is shuffled by source
    count, size = e.agg(F.count("*"), F.sum(F.coalesce(F.octet_length(F.col("s").cast("string")), F.lit(0)) + 64)).first()
    e = F.broadcast(e) if not count or size <= BROADCAST_BYTES else e
    names = [c for c in docs.columns if copy is None or c.lower() != copy.lower()]
    rows = docs.select(F.col(source).alias("source"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), seeded_unit(seed, F.col(doc_id)).alias("u"))
    whole = F.floor(F.col("e"))
    times = (whole + F.when(F.col("u") < F.col("e") - whole, 1).otherwise(0)).cast("int")
    out = rows.join(e, same(F.col("source"), F.col("s"))).withColumn("times", times).where("times > 0").select("row", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    return out.select("row.*", *([F.col("copy").alias(copy)] if copy else []))
