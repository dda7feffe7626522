"""Document-topic relation: topic lists and +1/-1 labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def topics_per_doc(topics: DataFrame) -> DataFrame:
    """(doc_id, topics ARRAY<STRING> sorted and distinct, n_lines).

    Repeated lines are folded first (a partial aggregate on (doc, topic)), so a
    document's list is bounded by the topic vocabulary, not by the number of
    lines it has."""
    per_pair = topics.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("c"))
    return per_pair.groupBy("doc_id").agg(
        F.array_sort(F.collect_list("topic")).alias("topics"),
        F.sum("c").cast("long").alias("n_lines"),
    )


def topic_flags(topics: DataFrame, category: str) -> DataFrame:
    """(doc_id, has): 1 if the document carries ``category``; one row per doc."""
    return topics.groupBy("doc_id").agg(
        F.max((F.col("topic") == category).cast("int")).alias("has"))


def topic_label(examples: DataFrame, topics: DataFrame, category: str,
                on_missing: str = "error", id_col: str = "id") -> DataFrame:
    """Add ``y`` = +1 if the example's document has ``category``, else -1.

    An example whose id has no topic at all raises at run time
    (``on_missing='error'``, the reference's KeyError) or is labelled -1
    (``on_missing='negative'``).  Membership is an existence test: the join
    side has one row per document, so rows never multiply."""
    flags = topic_flags(topics, category).withColumnRenamed("doc_id", id_col)
    j = examples.join(flags, id_col, "left")
    if on_missing == "error":
        missing = F.raise_error(F.concat(F.lit("document without topic: "), F.col(id_col).cast("string")))
        y = F.when(F.col("has").isNull(), missing.cast("int")).when(F.col("has") == 1, 1).otherwise(-1)
    elif on_missing == "negative":
        y = F.when(F.col("has") == 1, 1).otherwise(-1)
    else:
        raise ValueError(on_missing)
    cols = [c for c in examples.columns]
    return j.select(*cols, y.cast("int").alias("y"))
