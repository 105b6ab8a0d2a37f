"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds modular prefix arrays of a text, with two moduli: any two spans, of
this text or another, are compared in constant time, and the longest common extension of
two places is found by binary search. A fingerprint is the hash of the whole text with the
``sketch`` smallest mixed hashes of its windows, all taken from the prefix arrays; the
likeness of two fingerprints estimates the Jaccard similarity of the window sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, read_table

WINDOW = 24
SKETCH = 32
MODULI = (2147483647, 2147483629)  # the two largest primes below 2**31: products stay below 2**62
BASES = (911382323, 972663749)
BITS = 40


class Powers:
    """Powers of the bases, grown on demand and shared by the texts of a task."""

    def __init__(self) -> None:
        self.of = [np.ones(1, dtype=np.uint64) for _ in MODULI]

    def upto(self, n: int, k: int) -> np.ndarray:
        have = self.of[k]
        p = np.uint64(MODULI[k])
        while len(have) < n:
            step = np.uint64(int(have[-1]) * BASES[k] % MODULI[k])
            have = self.of[k] = np.concatenate([have, have * step % p])
        return have[:n]


class PrefixHash:
    """Prefix arrays of one text: ``pre[k][i]`` is the sum of (code + 1) * base**j over j < i, by modulus k."""

    def __init__(self, text: str, powers: Powers):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n, self.powers, self.pre = len(codes), powers, []
        for k, p in enumerate(MODULI):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(codes * powers.upto(self.n, k) % np.uint64(p), out=sums[1:])
            self.pre.append(sums % np.uint64(p))

    def spans(self, starts: np.ndarray, stops: np.ndarray, top: int) -> np.ndarray:
        """Hashes of spans, shifted so that spans at any place of texts up to ``top`` long compare."""
        out = np.zeros(len(starts), dtype=np.uint64)
        for k, p in enumerate(MODULI):
            m = np.uint64(p)
            part = (self.pre[k][stops] + m - self.pre[k][starts]) % m
            out = (out << np.uint64(31)) ^ (part * self.powers.upto(top + 1, k)[top - starts] % m)
        return out

    def equal(self, start: int, other: PrefixHash, other_start: int, length: int) -> bool:
        if start + length > self.n or other_start + length > other.n:
            return False
        top = max(self.n, other.n)
        one = np.array([start]), np.array([start + length])
        two = np.array([other_start]), np.array([other_start + length])
        return bool(self.spans(*one, top)[0] == other.spans(*two, top)[0])

    def extension(self, start: int, other: PrefixHash, other_start: int) -> int:
        """The longest common extension of the two places, by binary search."""
        low, high = 0, min(self.n - start, other.n - other_start)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(start, other, other_start, mid):
                low = mid
            else:
                high = mid - 1
        return max(low, 0)

    def windows(self, width: int) -> np.ndarray:
        """Place-independent hashes of all windows; of the whole text where it is shorter."""
        width = min(width, self.n)
        if not width:
            return np.zeros(0, dtype=np.uint64)
        n = self.n - width + 1
        out = np.zeros(n, dtype=np.uint64)
        for k, p in enumerate(MODULI):
            m = np.uint64(p)
            part = self.pre[k][width:] + m - self.pre[k][:n]
            part %= m
            # Dividing by base**start is multiplying by a power of the inverse.
            part *= self.powers_of_inverse(n, k)
            part %= m
            out = (out << np.uint64(31)) ^ part
        return out

    def powers_of_inverse(self, n: int, k: int) -> np.ndarray:
        cache = self.powers.__dict__.setdefault("inverse", [np.ones(1, dtype=np.uint64) for _ in MODULI])
        have, p = cache[k], MODULI[k]
        inverse = pow(BASES[k], -1, p)
        while len(have) < n:
            step = np.uint64(int(have[-1]) * inverse % p)
            have = cache[k] = np.concatenate([have, have * step % np.uint64(p)])
        return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix, so that the smallest values are a uniform choice."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def fingerprint(prefix: PrefixHash, window: int = WINDOW, sketch: int = SKETCH) -> tuple[str, np.ndarray]:
    """The fingerprint as text, and its window hashes: equal for equal texts."""
    values = mixed(prefix.windows(window)) >> np.uint64(64 - BITS)
    if len(values) > 4 * sketch:
        rough = np.partition(values, 4 * sketch)[: 4 * sketch]
        smallest = np.unique(rough)[:sketch]
        if len(smallest) < sketch:  # many repeats
            smallest = np.unique(values)[:sketch]
    else:
        smallest = np.unique(values)[:sketch]
    whole = "".join(f"{int(pre[-1]):08x}" for pre in prefix.pre)
    return f"{prefix.n:x}-{whole}-" + "".join(f"{int(v):010x}" for v in smallest), smallest


def likeness(a: np.ndarray, b: np.ndarray, sketch: int = SKETCH) -> float:
    """Estimated Jaccard similarity: of the smallest values of both, the share that both have."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:sketch]
    return float(np.isin(np.intersect1d(a, b), union).sum() / len(union))


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def fingerprints(documents: DataFrame, window: int = WINDOW, sketch: int = SKETCH) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Rows follow each other by ascending doc_id (null first), repeated ids by a hash of the
    text; after the last comes the first. A null text is an empty one; two empty texts are
    alike (1), an empty and another are not (0). A text shorter than the window is one
    window. Repeated rows are kept. A table of one row follows itself; an empty table
    gives an empty result. Other columns are not read.

    Texts move once: ranges of doc_id are dealt to buckets, each bucket is sorted and read
    as a stream, and the first row of the next bucket that has rows is sent along as a
    guest. What the driver holds is a few numbers for each bucket.
    """
    spark = documents.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    n = 4 * partitions(spark)
    cuts = rows.select("doc_id").where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)
    cuts = sorted({int(c) for c in cuts})
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.size(F.filter(F.array(*[F.lit(c).cast("long") for c in cuts]), lambda c: c <= F.col("doc_id")))) if cuts else F.lit(0)
    tie = F.xxhash64("text")
    marked = rows.withColumn("tie", tie).withColumn("bucket", bucket)
    heads = marked.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "tie")).alias("head")).orderBy("bucket").collect()
    # Each bucket's guest is the head of the bucket after it.
    host = {(heads[i]["head"]["doc_id"], heads[i]["head"]["tie"]): heads[i - 1]["bucket"] for i in range(len(heads))}
    if not host:
        return spark.createDataFrame([], OUT)
    visits = spark.createDataFrame([(d, t, b) for (d, t), b in host.items()], "vid long, vtie long, host int")
    seats = F.when(F.col("host").isNull(), F.array(F.struct(F.col("bucket").alias("seat"), F.lit(False).alias("guest")))).otherwise(
        F.array(F.struct(F.col("bucket").alias("seat"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("seat"), F.lit(True).alias("guest")))
    )
    seated = marked.join(F.broadcast(visits), F.col("doc_id").eqNullSafe(F.col("vid")) & (F.col("tie") == F.col("vtie")), "left")
    dealt = seated.select("doc_id", "text", "tie", F.explode(seats).alias("s")).select("doc_id", "text", "tie", "s.seat", "s.guest")
    sorted_rows = dealt.repartition(partitions(spark), "seat").sortWithinPartitions("seat", "guest", F.asc_nulls_first("doc_id"), "tie")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        powers = Powers()
        held: tuple | None = None  # (seat, doc_id, text, prefix, fingerprint, sketch)
        guest_of: int | None = None
        out: list[tuple] = []

        def close(row: tuple, text: str, prefix: PrefixHash, smallest: np.ndarray) -> None:
            changed = edited_text(row[2], text)
            other = PrefixHash(changed, powers)
            name, own = fingerprint(other, window, sketch)
            sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((row[1], row[3].n, sha, row[4], name, likeness(row[5], own, sketch), likeness(row[5], smallest, sketch), row[3].extension(0, other, 0)))

        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.guest and guest_of == r.seat:
                    continue  # a repeated head: one guest is enough
                prefix = PrefixHash(r.text, powers)
                name, smallest = fingerprint(prefix, window, sketch)
                if held and held[0] == r.seat:
                    close(held, r.text, prefix, smallest)
                if r.guest:
                    held, guest_of = None, r.seat
                else:
                    held = (r.seat, r.doc_id, r.text, prefix, name, smallest)
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")]).astype({"doc_id": "Int64"})
                out = []

    return sorted_rows.mapInPandas(read, OUT)


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(read_table(spark, sf_dir, "documents"))
