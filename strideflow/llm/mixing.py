"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Targets share out a budget of words by weight and stop at a cap; documents of a source are
shuffled by a hash and cut into blocks of equal words, smaller ones for a source with a
small target, so that it too has many; a schedule of slots maps golden-ratio points
through the cumulative numbers of blocks that targets ask for to sources, ranks the slots
of each source, and joins the slot of rank r to the source's block r, beginning again
after the last. Every part of the mix thus has each source near its share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import group_rows, read_table, staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Slots of the whole mix, and those that each source has at least (or one a word).
SLOTS, LEAST_SLOTS = 20_000, 1000
#: Golden-ratio points for each slot. Of any part of the line they hit its share but for a few, so with
#: three a slot every source has as many as it asks for; it takes its first.
POINTS = 3
#: Rows of a plan that are sent to all executors at most; a larger one is joined by a shuffle.
SENT = 200_000
WORD = r"[^\x20\x09-\x0D]+"
#: The fractional part of the golden ratio, to 15 digits as SQL reads it.
GOLDEN = 0.618033988749895


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Each source's weight and target, from source and source_size.

    Sources are numbered by code point, null last, and weighed in turn. What a target
    has above ``most`` times its source goes to the others by weight, until none is
    above; that is the level at which all targets, as far as they are below their caps,
    are in proportion to their weights. The table of sources is small: one row each.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    at = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")).cast("double")
    named = sources.withColumn("at", at).withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * most)
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "at")
    everything = Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(share)
    rest_weight = F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    full_before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (budget - full_before) / rest_weight
    found = named.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    open_level = F.max(F.when(~F.col("capped"), F.col("level"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(open_level * F.col("weight"))
    return found.withColumn("target", target).select("source", "at", "weight", "source_size", "target")


def sized(documents: DataFrame) -> DataFrame:
    """Rows as (mix_row, source, mix_size, mix_order): the row itself, its source, words and place in the shuffle."""
    key = F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string")))
    return documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("mix_row"),
        F.col("source"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("mix_size"),
        F.conv(F.substring(key, 1, 12), 16, 10).cast("long").alias("mix_order"),
    )


def stepped(aims: DataFrame, slots: int, least: int) -> DataFrame:
    """``aims`` (at, source_size, target, ...) with step, the words of a block of the source, and turns, the blocks that its target asks for."""
    whole = F.sum(F.floor("target").cast("long")).over(Window.partitionBy())
    step = F.greatest(F.least(whole / F.lit(float(slots)), F.col("target") / F.lit(float(least))), F.lit(1.0))
    return aims.withColumn("step", step).withColumn("turns", F.floor(F.col("target") / F.col("step") + 0.5).cast("long"))


def sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SENT else df


def schedule(aims: DataFrame, most: int) -> DataFrame:
    """How often each block is taken, and the first slot that takes it: at, block, mix_times, mix_slot.

    ``aims``: at, source_size, target, step, turns. The result has a row for each turn at
    most: as many as the slots, and the least number for each small source.
    """
    spark = aims.sparkSession
    upto = F.sum("turns").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    lines = aims.where("turns > 0").withColumn("high", upto).withColumn("low", F.col("high") - F.col("turns"))
    blocks = F.greatest(F.ceil(F.col("source_size") / F.col("step")), F.lit(1)).cast("long")
    lines = staged(lines.select("at", "turns", "low", "high", blocks.alias("blocks")), "mix-lines")
    whole = lines.agg(F.coalesce(F.max("high"), F.lit(0)).alias("whole"), F.count(F.lit(1)).alias("n")).first()
    golden = (F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)
    points = spark.range(POINTS * whole["whole"] + 64 if whole["whole"] else 0).withColumn("point", (golden - F.floor(golden)) * F.lit(float(whole["whole"])))
    # Points meet sources in cells of the line, as many as there are sources.
    cell = lambda x: F.floor(F.col(x).cast("double") * F.lit(whole["n"] / max(whole["whole"], 1))).cast("long")
    in_cells = lines.withColumn("cell", F.explode(F.sequence(cell("low"), cell("high"))))
    met = points.withColumn("c", cell("point")).join(sent(in_cells, whole["n"]), (F.col("c") == F.col("cell")) & (F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    ranked = met.withColumn("rank", F.row_number().over(Window.partitionBy("at").orderBy("id")) - 1)
    turns = ranked.where((F.col("rank") < F.col("turns")) & (F.col("rank") < F.col("blocks") * most))
    return turns.groupBy("at", F.pmod("rank", F.col("blocks")).cast("long").alias("block")).agg(F.count(F.lit(1)).cast("int").alias("mix_times"), F.min("id").alias("mix_slot"))


def mix(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, slots: int = SLOTS, least: int = LEAST_SLOTS) -> DataFrame:
    """What the mix takes of each row of ``rows`` (as ``sized`` makes them).

    Returns mix_row, mix_size, mix_source_size, mix_target, mix_times (0 to ``most``: how
    often the mix holds the row) and mix_slot (the first slot that holds it, null if none).
    A null text has no words; rows without words share the fate of the block they lie in;
    a null source is a source, named last. Equal rows lie next to each other in the
    shuffle. Rows are carried in one struct, so no name can clash. An empty table gives an
    empty result. Reruns agree: order comes from a hash of doc_id.
    """
    spark = rows.sparkSession
    sources = staged(rows.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    aims = staged(stepped(targets(sources.select("source", "source_size"), weights, share, most), slots, least), "mix-targets")
    per = group_rows(sources.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], spark)

    # Words of a source before each row, in levels: pieces of the shuffled order, then rows of a piece.
    pieces = F.ceil(F.col("n") / F.lit(per)).cast("long")
    numbers = sources.select(F.col("source").alias("s1"), pieces.alias("pieces"))
    known = aims.join(numbers, F.col("source").eqNullSafe(F.col("s1"))).select(F.col("source").alias("s0"), "at", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "step", "pieces")
    piece = F.floor(F.col("mix_order") / F.lit(float(1 << 48)) * F.col("pieces")).cast("long")
    dealt = rows.join(known, F.col("source").eqNullSafe(F.col("s0"))).withColumn("piece", piece).drop("s0", "pieces")
    before = Window.unboundedPreceding, -1
    pblock = F.floor(F.col("piece") / F.lit(4096))
    sums = dealt.groupBy("at", "piece").agg(F.sum("mix_size").alias("words")).withColumn("pblock", pblock)
    block_sums = sums.groupBy("at", "pblock").agg(F.sum("words").alias("words"))
    block_first = block_sums.select("at", "pblock", F.coalesce(F.sum("words").over(Window.partitionBy("at").orderBy("pblock").rowsBetween(*before)), F.lit(0)).alias("block_first"))
    in_block = F.coalesce(F.sum("words").over(Window.partitionBy("at", "pblock").orderBy("piece").rowsBetween(*before)), F.lit(0))
    firsts = sums.withColumn("in_block", in_block).join(block_first, ["at", "pblock"]).select("at", "piece", (F.col("in_block") + F.col("block_first")).alias("first_word"))
    within = Window.partitionBy("at", "piece").orderBy("mix_order", "mix_size").rowsBetween(*before)
    ordered = dealt.withColumn("in_piece", F.coalesce(F.sum("mix_size").over(within), F.lit(0))).join(firsts, ["at", "piece"])
    start = F.col("in_piece") + F.col("first_word")
    numbered = ordered.withColumn("block", F.floor(start / F.col("step")).cast("long"))
    taken = staged(schedule(aims, most), "mix-taken")
    out = numbered.join(sent(taken, taken.count()), ["at", "block"], "left")
    return out.select("mix_row", "mix_size", "mix_source_size", "mix_target", F.coalesce("mix_times", F.lit(0)).alias("mix_times"), "mix_slot")


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """What a mix of 150% of all words takes of each document."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = sized(documents).select(F.struct("mix_row.doc_id").alias("mix_row"), "source", "mix_size", "mix_order")
    out = mix(staged(rows, "mix-rows"))
    return out.select(
        "mix_row.doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_times")).alias("taken"),
    )


OP8_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws(':', 'mix', doc_id::VARCHAR)), 1, 12))::BIGINT AS o
  FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS nr,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         2.0::DOUBLE * source_size AS cap FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT *, CASE WHEN cap <= level * weight THEN cap
                 ELSE weight * max(CASE WHEN cap > level * weight THEN level END) OVER () END AS target FROM l
), line AS (
  SELECT *, sum(turns) OVER (ORDER BY nr)::DOUBLE AS high, (sum(turns) OVER (ORDER BY nr) - turns)::DOUBLE AS low, sum(turns) OVER () AS whole,
         greatest(ceil(source_size / step), 1)::BIGINT AS blocks
  FROM (SELECT *, floor(target / step + 0.5::DOUBLE)::BIGINT AS turns FROM (
    SELECT *, greatest(least((sum(floor(target)::BIGINT) OVER ())::DOUBLE / {SLOTS}.0::DOUBLE, target / {LEAST_SLOTS}.0::DOUBLE), 1.0::DOUBLE) AS step FROM t))
), p AS (
  SELECT i AS id, ((i + 0.5::DOUBLE) * {GOLDEN}::DOUBLE - floor((i + 0.5::DOUBLE) * {GOLDEN}::DOUBLE)) * (SELECT max(whole) FROM line)::DOUBLE AS point
  FROM (SELECT unnest(range((SELECT ({POINTS} * max(whole) + 64)::BIGINT FROM line))) AS i)
), k AS (
  SELECT nr, turns, blocks, row_number() OVER (PARTITION BY nr ORDER BY id) - 1 AS rank
  FROM p JOIN line ON point >= low AND point < high
), n AS (SELECT nr, rank % blocks AS block, count(*) AS times FROM k WHERE rank < turns AND rank < {MOST} * blocks GROUP BY ALL
), b AS (
  SELECT d.*, t.nr, t.source_size, t.target, t.step,
         coalesce(sum(size) OVER (PARTITION BY t.nr ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word
  FROM d JOIN line t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, (size * coalesce(times, 0))::BIGINT AS taken
FROM b LEFT JOIN n ON n.nr = b.nr AND n.block = floor(first_word / step)::BIGINT
"""
