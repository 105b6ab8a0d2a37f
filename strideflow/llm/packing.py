"""Best-fit packing in bulk-synchronous rounds.

Documents are token sequences; a sequence of the output holds at most ``capacity`` tokens.
Documents go from long to short, in bands of length. In a round, the documents of the band
and the gaps of the open sequences are sorted by range, and every task sweeps its range
for successors: each document goes to the smallest gap that can hold it, and where several
want a gap the longest has it. What finds no partner in its range is ranked there; counts
for each range say which ranks of which ranges meet. Gaps are updated and the next round
begins, until nothing fits; then sequences are opened, as many as the tokens left need
beyond the gaps. Where documents outnumber gaps, a wide gap counts as several for a round.
Short documents travel in bundles of equal ones, which are halved when
they fit nowhere. What the driver holds is a few numbers for each range.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import group_rows, lean, partitions, read_table, small_batches, staged, unit_hash, within_rank

CAPACITY = 2048
END_ID = 0
#: The part of the capacity that a bundle of short documents has at most, and rows that a task sweeps.
BUNDLE, SWEPT = 16, 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_files(name: str = "byte_bpe_50k") -> tuple[str, str]:
    """Paths of the vocabulary: the tokenizers file and the same vocabulary as ranks."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json"), public_tokenizers.path(f"{name}.tiktoken")


def encoder(files: tuple[str, str], special: str = "<|endoftext|>"):
    """A function from a text to its ids, as the tokenizers library gives them.

    Both files hold one vocabulary. Ids come from the ranks, which take a quarter of the
    time; a text that holds a special token's string goes to the tokenizers library, as it
    alone defines what becomes of it, and is loaded at the first such text. Tests hold both against each other.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full: list[Tokenizer] = []
    with open(files[1], "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if special in text or any("\ud800" <= c <= "\udfff" for c in text if c > "퟿"):
            if not full:
                full.append(Tokenizer.from_file(files[0]))
            return full[0].encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def tokenised(documents: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, files: tuple[str, str] | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A null text is an empty one, and so a piece of the end id alone. A document longer than
    the capacity is cut into pieces of exactly the capacity; only its first may be shorter.
    Repeated rows are cut each; an empty table gives an empty result. Other columns are not read.
    """
    small_batches(documents.sparkSession)
    files = files or tokenizer_files()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(files)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                at, stop, k = 0, len(ids) % capacity or min(capacity, len(ids)), 0
                while at < len(ids):
                    part = ids[at:stop]
                    crc = zlib.crc32(part.tobytes())
                    rows.append((doc_id, k, at, len(part), crc, part.astype("int32")) if keep_ids else (doc_id, k, at, len(part), crc))
                    at, stop, k = stop, stop + capacity, k + 1
            frame = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)
            yield frame.astype({"doc_id": "Int64"})

    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInPandas(lean(cut), PIECES + ", ids array<int>" * keep_ids)


def nested(is_gap: np.ndarray) -> np.ndarray:
    """The partner (its place, or -1) of each of the documents and gaps that are sorted by size, a document before a gap of its size.

    Gaps from the smallest up take the longest document before them that is still free:
    the pairs that documents from the longest down make with their smallest gap.
    """
    out = np.full(len(is_gap), -1, dtype=np.int64)
    depth = np.cumsum(np.where(is_gap, -1, 1)) + is_gap  # of the document itself, and of the one that a gap closes
    order = np.argsort(depth, kind="stable")
    pair = np.flatnonzero((depth[order][1:] == depth[order][:-1]) & ~is_gap[order][:-1] & is_gap[order][1:])
    out[order[pair]], out[order[pair + 1]] = order[pair + 1], order[pair]
    return out


def between(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Which of the free documents and gaps of ranges meet: (document range, first rank, gap range, first rank, count, first pair).

    ``ranges``: number, free gaps, free documents, by size. Documents are ranked from the
    longest down, gaps from the smallest up; in a range, free gaps are below free documents.
    """
    out, pairs = [], 0
    left: list[list[int]] = []  # range, free documents, those that are taken
    for number, gaps, documents in sorted(ranges):
        done = 0
        while done < gaps and left:
            n = min(gaps - done, left[-1][1] - left[-1][2])
            out.append((left[-1][0], left[-1][2], number, done, n, pairs))
            done, pairs = done + n, pairs + n
            left[-1][2] += n
            if left[-1][2] == left[-1][1]:
                left.pop()
        if documents:
            left.append([number, documents, 0])
    return out


ITEM = "unit long, first long, count long"
STATE = ("kind", "unit", "first", "count", "seq", "gap")


def swept(documents: DataFrame, gaps: DataFrame, rows: int) -> DataFrame:
    """One round: a row for each pair (kind ``pair``) and for each document or gap without a partner (``doc``, ``gap``).

    ``documents``: unit, first, count (``count`` documents of ``unit`` tokens, by rank from
    ``first`` on); ``gaps``: seq, gap. Columns as in STATE.
    """
    spark = documents.sparkSession
    none = F.lit(None).cast("long")
    items = documents.select((F.col("unit") * F.col("count")).alias("size"), F.lit(0).alias("is_gap"), F.xxhash64("unit", "first").alias("tie"), "unit", "first", "count", none.alias("seq"))
    items = items.unionByName(gaps.select(F.col("gap").alias("size"), F.lit(1).alias("is_gap"), F.xxhash64("seq").alias("tie"), none.alias("unit"), none.alias("first"), none.alias("count"), "seq"))
    order = ["size", "is_gap", "tie", "unit", "first", "seq"]
    ranged = items.repartitionByRange(max(1, min(partitions(spark), -(-rows // SWEPT))), *order).sortWithinPartitions(*order)

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        own = pd.concat(held, ignore_index=True)
        is_gap = own["is_gap"].to_numpy() == 1
        partner = nested(is_gap)
        free = partner < 0
        paired = np.flatnonzero(~free & ~is_gap)
        met = own.loc[paired, ["unit", "first", "count"]].assign(kind="pair", seq=own["seq"].to_numpy()[partner[paired]], gap=own["size"].to_numpy()[partner[paired]], rank=0)
        documents, gaps = own[free & ~is_gap].iloc[::-1], own[free & is_gap]
        alone = pd.concat([
            documents[["unit", "first", "count"]].assign(kind="doc", rank=np.arange(len(documents))),
            gaps[["seq"]].assign(kind="gap", gap=gaps["size"], rank=np.arange(len(gaps))),
        ])
        out = pd.concat([met, alone]).assign(part=TaskContext.get().partitionId())
        yield out.reindex(columns=[*STATE, "rank", "part"]).astype({c: "Int64" for c in ("unit", "first", "count", "seq", "gap")})

    local = staged(ranged.mapInPandas(sweep, f"kind string, {ITEM}, seq long, gap long, rank long, part int"), "pack-swept")
    sizes: dict[int, list[int]] = {}
    for r in local.where("kind <> 'pair'").groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n")).collect():  # two numbers for each range
        sizes.setdefault(r["part"], [0, 0])[r["kind"] == "doc"] = r["n"]
    met = between([(part, *n) for part, n in sizes.items()])
    if not met:
        return local.select(*STATE)
    meeting = spark.createDataFrame([(kind, part, rank, rank + n - 1, pair) for d, i, g, j, n, pair in met for kind, part, rank in (("doc", d, i), ("gap", g, j))], "k string, p int, low long, high long, pair long")
    where = (F.col("kind") == F.col("k")) & (F.col("part") == F.col("p")) & F.col("rank").between(F.col("low"), F.col("high"))
    # Twice as many rows as ranges at most.
    free = local.where("kind <> 'pair'").join(F.broadcast(meeting), where, "left").withColumn("pair", F.col("pair") + F.col("rank") - F.col("low"))
    documents = free.where("kind = 'doc' and pair is not null").select("unit", "first", "count", "pair")
    taken = free.where("kind = 'gap' and pair is not null").select("seq", "gap", F.col("pair").alias("q"))
    crossed = documents.join(taken, F.col("pair") == F.col("q")).select(F.lit("pair").alias("kind"), "unit", "first", "count", "seq", "gap")
    return local.where("kind = 'pair'").select(*STATE).unionByName(crossed).unionByName(free.where("pair is null").select(*STATE))


def parted(gaps: DataFrame, width: int, times: int) -> DataFrame:
    """Gaps (seq, gap) as up to ``times`` ones of ``width`` tokens at least, as far as they hold them."""
    t = F.greatest(F.least(F.floor(F.col("gap") / width), F.lit(times)), F.lit(1)).cast("long")
    rest = F.array_repeat(F.lit(width).cast("long"), (t - 1).cast("int"))
    return gaps.select("seq", F.explode(F.concat(F.array(F.col("gap") - (t - 1) * width), rest)).alias("gap"))


def placed(ranked: DataFrame, counts: dict[int, int], capacity: int) -> DataFrame:
    """unit, first, count and seq for all documents; ``ranked``: length and __at, the rank within it.

    ``counts``: documents of each length.
    """
    spark = ranked.sparkSession
    widest = max(1, capacity // BUNDLE)
    bundle = F.floor(F.col("__at") / F.greatest(F.floor(F.lit(widest) / F.col("length")), F.lit(1)))
    items = ranked.groupBy(F.col("length").alias("unit"), bundle.alias("b")).agg(F.min("__at").alias("first"), F.count(F.lit(1)).alias("count")).select("unit", "first", "count")
    items = staged(items, "pack-items")
    size = F.col("unit") * F.col("count")
    doc, gap = F.col("kind") == "doc", F.when(F.col("kind") == "pair", F.col("gap") - size).when(F.col("kind") == "gap", F.col("gap"))
    remaining, room, opened = sum(n * length for length, n in counts.items()), 0, 0
    gaps, widest_gap, open_ = spark.createDataFrame([], "seq long, gap long"), 0, 0
    done: list[DataFrame] = []
    halved: DataFrame | None = None
    high = capacity
    while high:
        low = high // 2 if high > widest else high // 4
        documents = items.where((size > low) & (size <= high))
        if halved is not None:
            documents, halved = documents.unionByName(halved.where((size > low) & (size <= high))), halved.where(size <= low)
        about = documents.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.sum(size).alias("tokens"), F.max("count").alias("bundled")).first()
        while about["n"]:
            if widest_gap < about["least"]:
                need = -(-(remaining - room) // capacity)
                if need <= 0 and about["bundled"] > 1:
                    # There is room, if only for less at once: bundles are halved, and come again with shorter ones.
                    half = F.floor(F.col("count") / 2).cast("long")
                    twice = documents.where("count > 1").withColumn("half", half)
                    parts = twice.select("unit", "first", F.col("half").alias("count")).unionByName(twice.select("unit", (F.col("first") + F.col("half")).alias("first"), (F.col("count") - F.col("half")).alias("count")))
                    parts = staged(parts if halved is None else parts.unionByName(halved), "pack-halved")
                    documents, halved = staged(documents.where("count = 1").unionByName(parts.where(size > low)), "pack-left"), parts.where(size <= low)
                    about = documents.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("least"), F.sum(size).alias("tokens"), F.max("count").alias("bundled")).first()
                    continue
                if need <= 0:
                    need = -(-about["tokens"] // capacity)
                if high == capacity:
                    need = max(need, about["n"])  # no two fit together
                fresh = spark.range(opened, opened + need).select(F.col("id").alias("seq"), F.lit(capacity).cast("long").alias("gap"))
                gaps, opened, room = gaps.unionByName(fresh), opened + need, room + need * capacity
                open_ += need
            times = -(-about["n"] // max(open_, 1))
            state = staged(swept(documents, parted(gaps, high, times) if times > 1 else gaps, about["n"] + opened), "pack-round")
            done.append(state.where("kind = 'pair'"))
            left = F.when(doc, size)
            about = state.agg(
                F.count(left).alias("n"), F.min(left).alias("least"), F.sum(left).alias("tokens"), F.max(F.when(doc, F.col("count"))).alias("bundled"),
                F.coalesce(F.max(gap), F.lit(0)).alias("widest"), F.count(F.when(gap >= about["least"], 1)).alias("open"), F.coalesce(F.sum(F.when(F.col("kind") == "pair", size)), F.lit(0)).alias("used"),
            ).first()
            remaining, room, open_ = remaining - about["used"], room - about["used"], about["open"]
            gaps = state.where(~doc).select("seq", gap.alias("gap")).where("gap > 0")
            widest_gap = about["widest"]
            if times > 1:  # what is left of parts of a gap is one gap again
                gaps = staged(gaps.groupBy("seq").agg(F.sum("gap").alias("gap")), "pack-gaps")
                widest_gap, open_ = gaps.agg(F.coalesce(F.max("gap"), F.lit(0)), F.count(F.when(F.col("gap") >= (about["least"] or 1), 1))).first()
            documents = state.where(doc).select("unit", "first", "count")
        high = low
    out = done[0]
    for pairs in done[1:]:
        out = out.unionByName(pairs)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ...).

    Ties between pieces of one length are broken by a hash, then doc_id, piece and
    start; repeated rows each get a place. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    if not counts:
        return pieces.withColumn("sequence_id", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long"))
    salt = unit_hash("doc_id", "piece", "start")
    order = [F.col("doc_id"), F.col("piece"), F.col("start")]
    ranked = staged(within_rank(pieces, "length", salt, order, "__at", group_rows(sum(counts.values()), spark)), "pack-ranked")
    runs = placed(ranked.select("length", "__at"), counts, capacity)
    turn = runs.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    spots = turn.select(F.col("unit").alias("__unit"), (F.col("first") + F.col("turn")).alias("__rank"), F.col("seq").alias("sequence_id"))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("__unit"), "__rank").rowsBetween(Window.unboundedPreceding, -1)  # of capacity rows at most
    spots = spots.withColumn("offset", F.coalesce(F.sum("__unit").over(before), F.lit(0)))
    return ranked.join(spots, (F.col("length") == F.col("__unit")) & (F.col("__at") == F.col("__rank"))).select(*pieces.columns, "sequence_id", "offset")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of at most 2048 tokens."""
    pieces = staged(tokenised(read_table(spark, sf_dir, "documents")), "pieces")
    return pack(pieces)
