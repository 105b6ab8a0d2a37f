"""Operators over message streams, as DataFrame functions: none needs more than joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = Window.unboundedPreceding, Window.currentRow


def unwrap(df: DataFrame, keys: list[str], order: list[str], value: str, bits: int, out: str) -> DataFrame:
    """Add ``out``: the running total of a wrapping counter, by key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    step = F.when(F.lag(value).over(w).isNull(), F.col(value)).otherwise(F.pmod(F.col(value) - F.lag(value).over(w), F.lit(1 << bits)))
    return df.withColumn("__step", step).withColumn(out, F.sum("__step").over(w.rowsBetween(*RUN)).cast("long")).drop("__step")


def compressed_timestamps(df: DataFrame, keys: list[str], order: list[str], explicit: str, offset: str, out: str) -> DataFrame:
    """Add ``out``: each row's time, from explicit times (null elsewhere) and 5-bit offsets.

    An explicit time anchors what follows; each offset moves on to the next time with those
    low bits. Before the first explicit time the anchor is 0.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("__anchor", F.count(explicit).over(w.rowsBetween(*RUN)))
    within = Window.partitionBy(*keys, "__anchor").orderBy(*order)
    low = F.coalesce(F.pmod(F.col(explicit), F.lit(32)), F.col(offset))
    step = F.when(F.col(explicit).isNotNull(), F.lit(0)).otherwise(F.pmod(low - F.coalesce(F.lag(low).over(within), F.lit(0)), F.lit(32)))
    base = F.coalesce(F.first(explicit, ignorenulls=True).over(within.rowsBetween(*RUN)), F.lit(0))
    return df.withColumn("__step", step).withColumn(out, (base + F.sum("__step").over(within.rowsBetween(*RUN))).cast("long")).drop("__anchor", "__step")


def as_of(uses: DataFrame, states: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Add ``out`` to uses: the last state of the same key at or before each use, by one union and window."""
    use, state = (df.select(F.struct(*columns).alias("x")).schema["x"].dataType for df, columns in ((uses, uses.columns), (states, [value])))
    a = states.select(*keys, *order, F.lit(0).alias("__kind"), F.struct(value).alias("__state"), F.lit(None).cast(use).alias("__use"))
    b = uses.select(*keys, *order, F.lit(1).alias("__kind"), F.lit(None).cast(state).alias("__state"), F.struct(*uses.columns).alias("__use"))
    w = Window.partitionBy(*keys).orderBy(*order, "__kind").rowsBetween(*RUN)
    found = a.unionByName(b).withColumn("__last", F.last("__state", ignorenulls=True).over(w)).where("__kind = 1")
    return found.select("__use.*", F.col(f"__last.{value}").alias(out))


def first_by(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The first row's columns by key."""
    top = F.min_by(F.struct(*columns), F.struct(*order))
    return df.groupBy(*keys).agg(top.alias("__top")).select(*keys, "__top.*")


def dedupe_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def ordinals(df: DataFrame, keys: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    """Add each row's number from 0 among its kind."""
    return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def joined_parts(df: DataFrame, keys: list[str], order: list[str], part: str, out: str, binary: bool = False) -> DataFrame:
    """Parts of each key put together in order: texts, or bytes."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(part).alias("__part"))))
    pieces = df.groupBy(*keys).agg(F.transform(parts, lambda x: x["__part"]).alias("__parts"))
    whole = F.aggregate("__parts", F.lit(b""), lambda a, x: F.concat(a, x)) if binary else F.array_join("__parts", "")
    return pieces.select(*keys, whole.alias(out))


def gap_filled(df: DataFrame, keys: list[str], order: list[str], micros: str, value: str, step: int = 250_000, most: int = 20) -> DataFrame:
    """keys, micros, value, filled: the samples, and up to ``most`` copies of a sample at every ``step`` of a longer gap after it."""
    w = Window.partitionBy(*keys).orderBy(*order)
    gap = F.col("__next") - F.col(micros)
    n = F.least(F.ceil(F.abs(gap) / step) - 1, F.lit(most))
    fills = F.when(F.col("__next").isNotNull() & (n >= 1), F.sequence(F.lit(1).cast("long"), n.cast("long"))).otherwise(F.array().cast("array<long>"))
    steps = F.concat(F.array(F.lit(0).cast("long")), fills)
    out = df.withColumn("__next", F.lead(micros).over(w)).withColumn("__k", F.explode(steps))
    return out.select(*keys, (F.col(micros) + F.col("__k") * step).alias(micros), F.col(value), (F.col("__k") > 0).alias("filled"))


def ranged_mean(records: DataFrame, samples: DataFrame, keys: list[str], micros: str, record_order: list[str], value: str, out: str, first_reach: int = 1_000_000) -> DataFrame:
    """Add ``out`` to records: the rounded mean of samples after the record before, up to the record; null if none.

    No range join: records and samples are ordered together, each sample belongs to the
    first record at or after it, and counts if it lies in that record's range. The first
    record reaches back ``first_reach``. Records of one time: the later one takes the last
    sample of its reach.
    """
    w = Window.partitionBy(*keys).orderBy(micros, *record_order)
    recs = records.withColumn("__before", F.lag(micros).over(w)).withColumn("__same", F.coalesce(F.col(micros) == F.col("__before"), F.lit(False)))
    recs = recs.withColumn("__start", F.when(F.col("__before").isNull() | F.col("__same"), F.col(micros) - first_reach).otherwise(F.col("__before")))
    recs = recs.withColumn("__id", F.row_number().over(w))
    distinct = recs.where("not __same").select(*keys, F.col(micros).alias("__at"), F.lit(1).alias("__kind"), "__start", F.lit(None).cast("double").alias("__value"), F.col(micros).alias("__rec"))
    points = samples.select(*keys, F.col(micros).alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast("long").alias("__start"), F.col(value).cast("double").alias("__value"), F.lit(None).cast("long").alias("__rec"))
    after = Window.partitionBy(*keys).orderBy("__at", "__kind").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    owned = distinct.unionByName(points).withColumn("__owner", F.first("__rec", ignorenulls=True).over(after)).withColumn("__from", F.first("__start", ignorenulls=True).over(after))
    inside = owned.where((F.col("__kind") == 0) & F.col("__owner").isNotNull() & (F.col("__at") > F.col("__from")))
    means = inside.groupBy(*keys, F.col("__owner").alias("__o")).agg(F.round(F.avg("__value")).cast("long").alias("__mean"), F.max_by("__value", "__at").cast("long").alias("__lastv"), F.max("__at").alias("__last_at"))
    match = [recs[k].eqNullSafe(means[k]) for k in keys] + [recs[micros] == F.col("__o")]
    joined = recs.join(means.select(*[F.col(k).alias(k) for k in keys], "__o", "__mean", "__lastv", "__last_at"), match[0] if len(match) == 1 else _all(match), "left")
    chosen = F.when(F.col("__same"), F.when(F.col("__last_at") > F.col("__start"), F.col("__lastv"))).otherwise(F.col("__mean"))
    return joined.select(*[recs[c] for c in records.columns], chosen.alias(out))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def skip_header(messages: DataFrame) -> DataFrame:
    """Without file_id messages."""
    return messages.where("mesg_num <> 0")


def data_only(messages: DataFrame, known: DataFrame) -> DataFrame:
    """Messages that the profile knows; the profile's table is a schema of fixed size."""
    return messages.join(F.broadcast(known.select("mesg_num")), "mesg_num", "left_semi")


def concat_chains(*segments: DataFrame) -> DataFrame:
    """Segments one after the other, numbered; the first record of each but the first starts a new chain."""
    out = None
    for k, s in enumerate(segments):
        part = s.withColumn("chain_idx", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out
