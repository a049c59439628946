"""Messages delivered more than once: one copy per identifier by hash aggregation.

The copy to keep is the smallest struct of (delivery time, tie-break, row hash),
taken with ``min_by``: each task keeps one candidate per identifier before the
shuffle, so a hot identifier costs one row per task and key. Rows without an
identifier can't be repeats of anything and pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergelens.session import fresh

#: White space at either end, no-break and other Unicode spaces included.
_EDGES = r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$"


def normal_id(column: str) -> Column:
    """Identifier without letter case and white space around it; blank gives null."""
    text = F.lower(F.regexp_replace(F.col(column).cast("string"), _EDGES, ""))
    return F.when(text != "", text)


def _quoted(df: DataFrame, name: str) -> Column:
    return df["`" + name.replace("`", "``") + "`"]


def delivery_groups(df: DataFrame, id_column: str, number_column: str, time_column: str, tie_column: str, payload: list[str] | None = None) -> DataFrame:
    """One row per message: ``message_id``, ``message_number``, ``deliveries`` and
    ``kept``, a struct of the ``payload`` columns (all, unless named) of the
    delivery to keep.

    Nulls: a null or blank identifier leaves the row out; null numbers are equal to
    each other; a null time or tie-break sorts last. Rows alike in every column are
    ties whose copies can't be told apart. An empty table gives no rows.
    """
    names = payload or df.columns
    whole = F.struct(*[_quoted(df, c).alias(c) for c in names])
    time, tie = F.col(time_column), F.col(tie_column)
    order = F.struct(time.isNull().alias("a"), time.alias("b"), tie.isNull().alias("c"), tie.alias("d"), F.xxhash64(*[_quoted(df, c) for c in df.columns]).alias("e"))
    return (
        df.select(normal_id(id_column).alias("message_id"), F.col(number_column).alias("message_number"), whole.alias("row"), order.alias("rank"))
        .where(F.col("message_id").isNotNull())
        .groupBy("message_id", "message_number")
        .agg(F.min_by("row", "rank").alias("kept"), F.count(F.lit(1)).cast("bigint").alias("deliveries"))
    )


def keep_one(df: DataFrame, id_column: str = "review_request_id", number_column: str = "pull_request_number", time_column: str = "received_at", tie_column: str = "delivery_id") -> DataFrame:
    """``df`` with exactly one row for each message, the earliest delivery; the
    columns stay as they are. Rows with a null or blank identifier are all kept."""
    groups = delivery_groups(df, id_column, number_column, time_column, tie_column)
    kept = groups.select(*[F.col("kept")["`" + c.replace("`", "``") + "`"].alias(c) if "`" in c else F.col("kept").getField(c).alias(c) for c in df.columns])
    return kept.unionByName(df.where(normal_id(id_column).isNull()))


#: Deliveries of one message in a block; pairs are made between blocks, so no task gets all of a hot message.
BLOCK = 512


def delivery_pairs(df: DataFrame, id_column: str = "review_request_id", number_column: str = "pull_request_number", time_column: str = "received_at", tie_column: str = "delivery_id", block: int = BLOCK) -> DataFrame:
    """Each pair of deliveries of one message, smaller ``tie_column`` first.

    The aggregate gives each message the delivery that is kept, by ``min_by``; that one
    stands for the message, and every delivery of a repeated message is joined to it.
    Pairs are made within a representative. They are the asked-for result, so k
    deliveries give k(k-1)/2 rows; a message with more than ``block`` deliveries is cut
    into blocks by hash, and each pair of blocks is a join key of its own.
    Deliveries with a null ``tie_column`` have no name and form no pair, and several
    rows of one name are one delivery; a name that stands in two messages pairs in both.
    """
    a, b = f"{tie_column}_a", f"{tie_column}_b"
    df = df.where(F.col(tie_column).isNotNull())
    groups = delivery_groups(df, id_column, number_column, time_column, tie_column, [tie_column]).where(F.col("deliveries") > 1)
    kept = groups.select(F.col("message_id").alias("m"), F.col("message_number").alias("n"), F.struct(F.xxhash64("message_id", "message_number").alias("message"), F.col("kept")[tie_column].alias("kept")).alias("representative"), "deliveries")
    keyed = df.select(normal_id(id_column).alias("message_id"), F.col(number_column).alias("message_number"), F.col(tie_column).alias("tie")).where(F.col("message_id").isNotNull())
    named = keyed.join(kept, (F.col("message_id") == F.col("m")) & F.col("message_number").eqNullSafe(F.col("n")))
    blocks = F.ceil(F.col("deliveries") / block).cast("int")
    # of all rows with one name in a message one is left
    each = named.groupBy("representative", "tie").agg(F.max(blocks).alias("blocks")).withColumn("own", F.pmod(F.xxhash64("tie"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least("own", other).alias("low"), F.greatest("own", other).alias("high")))
    spread = each.select("representative", "tie", "own", F.explode(meets).alias("at")).select("representative", "tie", "own", "at.low", "at.high")
    left, right = spread.alias("l"), spread.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("representative", "low", "high")]
    # within a block each pair once; between two blocks one side from either
    sides = (F.col("l.low") == F.col("l.high")) | (F.col("l.own") != F.col("r.own"))
    pairs = left.join(right, same[0] & same[1] & same[2] & (F.col("l.tie") < F.col("r.tie")) & sides)
    return pairs.select(F.col("l.tie").alias(a), F.col("r.tie").alias(b))
