"""The learning-rate schedule as a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexivec.plans.kernel import RATE_FLOOR
from lexivec.sources.sorted_tables import with_total_before, write_in_order


def learning_rate_schedule(sentences: DataFrame, order: Sequence[str], step_size: float,
                           learners: int, epoch: int, epochs: int, total: int) -> DataFrame:
    """Rows of ``learner, ..., ids`` with ``words_before`` and ``alpha`` in place of the ids: the
    words a learner has seen before the sentence and the rate it trains the sentence with.

    The running sum is taken in pieces of a sorted table, so a learner's rows need not fit one
    task."""
    words = sentences.withColumn("n", F.size("ids").cast("bigint")).drop("ids")
    ordered = write_in_order(words, "learner", *order, label="schedule")
    started = with_total_before(ordered, F.col("n"), "start", "learner")
    inside = (Window.partitionBy("learner", "part").orderBy("row")
              .rowsBetween(Window.unboundedPreceding, -1))
    before = (F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))).cast("bigint")
    done = F.lit(float(learners)) * F.col("words_before") + float((epoch - 1) * total)
    rate = F.lit(step_size) * (1 - done / float(epochs * total + 1))
    return (started.withColumn("words_before", before).drop("n", "start", "part", "row")
            .withColumn("alpha", F.greatest(rate, F.lit(step_size * RATE_FLOOR))))
