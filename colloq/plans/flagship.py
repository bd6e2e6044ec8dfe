"""The flagship query: conversations to masked training pairs, summed up per conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import medallion, privacy
from ..session import table


def masked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_pairs, n_masked, n_chars: one scan, one shuffle on the conversation."""
    rows = table(spark, sf_dir, "conversations")
    found = medallion.pairs(rows, ["conv_id"], ["turn"], F.col("role") == "assistant", "text")
    both = F.concat_ws("\n", "text", "response")
    hits = privacy.count(both, "email") + privacy.count(both, "phone")
    masked = privacy.mask(privacy.mask(both, "email"), "phone")
    return found.groupBy("conv_id").agg(F.count("*").alias("n_pairs"), F.sum(hits).alias("n_masked"), F.sum(F.length(masked)).alias("n_chars"))
