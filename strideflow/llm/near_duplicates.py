"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Texts become sets of five-word shingles, weighed by their count in the text and a smoothed
inverse document frequency. Improved consistent weighted sampling draws from each weighted
set samples that two sets share with the probability of their weighted Jaccard similarity;
bands of samples put similar texts into common buckets. The members of a bucket are held
against two of them first (stars). In buckets whose members are then in more than one
component, all pairs of members from different components are verified, in blocks of
members, without a row for each pair: two texts that share a bucket are compared or already
linked. Candidates are verified by the weighted Jaccard similarity itself; classes are the
connected components of verified links.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, partitions, read_table, release, small_batches, staged, text_or_empty

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 4
HASH_BITS = 44
CHUNK = 1 << 20
SEED = 5
#: Rows of a chunk, whose shingles are asked for and answered together.
ROWS_A_CHUNK = 2048
#: Members of a bucket that are held against as many others at once, and about how many characters their texts may have together.
BLOCK, BLOCK_CHARS = 512, 1 << 22
#: Parts of the hash range for each shuffle partition, so that a task of the count holds little.
PARTS = 4

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to distinct shingles with counts, a chunk at a time, without a loop over words."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 2 * CHUNK)
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, BASE, dtype=np.uint64)]), dtype=np.uint64)
                self.inverses = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, INVERSE, dtype=np.uint64)]), dtype=np.uint64)

    def shingles(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For a chunk of texts: document number, shingle hash and count, by document and hash.

        Words are what white space separates, in lower case. A text of fewer words than a
        shingle has one of all its words; a text without words has none.
        """
        raw = [t.lower().encode("utf-8", "surrogatepass") + b"\n" for t in texts]
        ends = np.cumsum([len(r) for r in raw])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.grow(len(data) + 1)
        blank = data <= 32
        first = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
        last = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
        if not len(first):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            sums = np.zeros(len(data) + 1, dtype=np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)], out=sums[1:])
            word = mixed((sums[last] - sums[first]) * self.inverses[first])
            owner = np.searchsorted(ends, first, side="right")
            n = len(word)
            counts = np.bincount(owner, minlength=len(texts))
            full = np.flatnonzero(owner[: n - self.words + 1] == owner[self.words - 1 :]) if n >= self.words else np.zeros(0, np.int64)
            joined = np.zeros(len(full), dtype=np.uint64)
            for j in range(self.words):
                joined = joined * np.uint64(0x100000001B3) + word[full + j]
            who = owner[full]
            short = np.flatnonzero((counts > 0) & (counts < self.words))
            if len(short):
                begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
                alone = []
                for d in short:
                    h = np.uint64(counts[d])
                    for w in word[begin[d] : begin[d] + counts[d]]:
                        h = h * np.uint64(0x100000001B3) + w
                    alone.append(h)
                joined, who = np.concatenate([joined, np.array(alone, dtype=np.uint64)]), np.concatenate([who, short])
            key = (who.astype(np.uint64) << np.uint64(HASH_BITS)) | (mixed(joined) >> np.uint64(64 - HASH_BITS))
        key.sort()
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.concatenate([begins, [len(key)]]))
        key = key[begins]
        return (key >> np.uint64(HASH_BITS)).astype(np.int64), key & np.uint64((1 << HASH_BITS) - 1), tf


def chunked(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Successive texts, about CHUNK characters at a time (a longer text is a chunk by itself)."""
    start, kept, size = 0, [], 0
    for i, t in enumerate(texts):
        if kept and size + len(t) > CHUNK:
            yield start, kept
            start, kept, size = i, [], 0
        kept.append(t)
        size += len(t)
    if kept:
        yield start, kept


def in_chunks(texts: DataFrame, rows: int = ROWS_A_CHUNK) -> DataFrame:
    """``texts`` written once, with ``chunk``: a number that up to ``rows`` successive rows share."""
    small_batches(texts.sparkSession)
    at = F.monotonically_increasing_id()
    part, row = F.shiftright(at, 33), F.pmod(at, F.lit(1 << 33))
    return staged(texts.withColumn("chunk", part * F.lit(1 << 32) + F.floor(row / F.lit(rows)).cast("long")), "dup-chunks")


def packed(hashes: np.ndarray) -> bytes:
    """Ascending numbers below 2**64 as their first and the steps between them, each in as few bytes as the widest step needs."""
    steps = np.diff(hashes)
    width = max(1, (int(steps.max(initial=0)).bit_length() + 7) // 8)
    return bytes((width,)) + hashes[:1].astype("<u8").tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    width, body = raw[0], np.frombuffer(raw, np.uint8, offset=9)
    wide = np.zeros((len(body) // width, 8), dtype=np.uint8)
    wide[:, :width] = body.reshape(-1, width)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1), wide.view("<u8").ravel()]), dtype=np.uint64)


def document_frequencies(chunks: DataFrame) -> DataFrame:
    """chunk, hashes, seen: for the shingles of each chunk that more than one document holds, how many do.

    Each shingle is counted by itself, over all of ``chunks`` (chunk, text), in the part of
    its hash; what is not in an answer is in one document. A chunk names each of its
    shingles once, so a common one is a row of numbers as long as the chunks are many.
    """
    parts = PARTS * partitions(chunks.sparkSession)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        for batch in batches:
            for number, own in batch.groupby("chunk")["text"]:
                found = [shingler.shingles(chunk)[1] for _, chunk in chunked(own.tolist())]
                hashes, seen = np.unique(np.concatenate(found), return_counts=True)
                part = (hashes * np.uint64(parts) >> np.uint64(HASH_BITS)).astype(np.int64)  # ranges of the hash, so ascending
                ends = np.searchsorted(part, np.arange(parts + 1))
                filled = np.flatnonzero(ends[1:] > ends[:-1])
                if len(filled):
                    cut = [slice(ends[k], ends[k + 1]) for k in filled]
                    yield pd.DataFrame({"part": filled, "chunk": number, "hashes": [packed(hashes[c]) for c in cut], "seen": [zlib.compress(seen[c].astype("<u4").tobytes(), 1) for c in cut]})

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, rows = None, []
        for batch in batches:
            for row in batch[["part", "chunk", "hashes", "seen"]].itertuples(index=False, name=None):
                if rows and row[0] != last:
                    yield recurring(rows)
                    rows = []
                last = row[0]
                rows.append(row[1:])
        if rows:
            yield recurring(rows)

    asked = chunks.select("chunk", "text").mapInPandas(lean(ask), "part int, chunk long, hashes binary, seen binary")
    return asked.repartition(parts, "part").sortWithinPartitions("part").mapInPandas(lean(answer), "chunk long, hashes binary, seen binary")


def recurring(rows: list[tuple]) -> pd.DataFrame:
    """Of what chunks name of one part (chunk, hashes, seen): for each chunk, the hashes that more than one document holds."""
    hashes = [unpacked(raw) for _, raw, _ in rows]
    every = np.concatenate(hashes)
    _, at = np.unique(every, return_inverse=True)
    sums = np.bincount(at, np.concatenate([np.frombuffer(zlib.decompress(seen), "<u4") for _, _, seen in rows])).astype("<u4")[at]
    out, start = [], 0
    for (number, _, _), own in zip(rows, hashes, strict=True):
        many = np.flatnonzero(sums[start : start + len(own)] > 1)
        if len(many):
            out.append((number, packed(own[many]), zlib.compress(sums[start + many].tobytes(), 1)))
        start += len(own)
    return pd.DataFrame(out, columns=["chunk", "hashes", "seen"])


def idf(frequencies: np.ndarray, rows: int) -> np.ndarray:
    """Smoothed inverse document frequency: 1 for what every document has, 2 for what one has."""
    return 1 + np.clip(np.log(max(rows, 1) / np.maximum(frequencies, 1)), 0, None) / np.log(rows + 2)


class Sampler:
    """Improved consistent weighted sampling with tabulated gamma and uniform draws."""

    def __init__(self, samples: int):
        r = np.random.default_rng(SEED)
        # Quantiles of Gamma(2, 1) at the middles of 2**16 equal parts, by Newton steps on its distribution function.
        u = (np.arange(1 << 16) + 0.5) / (1 << 16)
        x = 1.0 + 2.5 * u
        for _ in range(60):
            x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
        self.gamma, self.log_gamma = x, np.log(x)
        self.seeds = r.integers(1, 1 << 63, size=samples, dtype=np.uint64)

    def signatures(self, hashes: np.ndarray, weights: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """One row for each document (its elements begin at ``begins``), one column for each sample."""
        out = np.zeros((len(begins), len(self.seeds)), dtype=np.uint64)
        log_w = np.log(weights)
        lengths = np.diff(np.concatenate([begins, [len(hashes)]]))
        mask = np.uint64(0xFFFF)
        with np.errstate(over="ignore"):
            for k, seed in enumerate(self.seeds):
                h = mixed(hashes * np.uint64(0x9E3779B97F4A7C15) + seed)
                r = self.gamma[(h & mask).astype(np.int64)]
                beta = (h >> np.uint64(32)).astype(np.float64) * (1 / (1 << 32))
                t = np.floor(log_w / r + beta)
                a = self.log_gamma[((h >> np.uint64(16)) & mask).astype(np.int64)] - r * (t - beta + 1)
                low = np.minimum.reduceat(a, begins)
                at = np.flatnonzero(a == np.repeat(low, lengths))
                at = at[np.searchsorted(at, begins)]  # the first of a document's minima
                out[:, k] = mixed(hashes[at] * np.uint64(0x9E3779B97F4A7C15) + t[at].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k))
        return out


def buckets_of(samples: np.ndarray, choices: np.ndarray) -> np.ndarray:
    """A bucket number for each row of ``samples`` and each choice (a row of ``choices``) of its columns."""
    out = np.zeros((len(samples), len(choices)), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for b, columns in enumerate(choices):
            h = np.full(len(samples), b + 1, dtype=np.uint64)
            for j in columns:
                h = mixed(h * np.uint64(0x100000001B3) + samples[:, j].astype(np.uint64))
            out[:, b] = h
    return out.astype(np.int64)


def signed(chunks: DataFrame, n: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key, total weight and document frequencies (null where a text has no words) and the bucket of each band.

    ``chunks``: doc_id, key, text, chunk, of ``n`` rows. ``seen`` holds the frequencies of a
    text's shingles in the order of their hashes, for ``weighed``.
    """
    choices = np.arange(bands * rows).reshape(bands, rows)

    def sign(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        shingler, sampler = Shingler(), Sampler(bands * rows)
        many = np.concatenate([np.zeros(0, "<u8"), *map(unpacked, answers["hashes"])])
        times = np.concatenate([np.zeros(0, "<u4"), *(np.frombuffer(zlib.decompress(raw), "<u4") for raw in answers["seen"])])
        # A chunk that lay in two batches has asked twice for what both hold, and has the same answer twice.
        order = np.argsort(many)
        many, times = np.append(many[order], np.uint64(1 << 63)), np.append(times[order], 1)
        found: list = [[]] * len(batch)
        total: list = [None] * len(batch)
        seen: list = [None] * len(batch)
        for start, chunk in chunked(batch["text"].tolist()):
            who, hashes, tf = shingler.shingles(chunk)
            if not len(who):
                continue
            begins = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
            at = np.searchsorted(many, hashes)
            held = np.where(many[at] == hashes, times[at], 1).astype("<u4")
            weights = tf * idf(held, n)
            samples = sampler.signatures(hashes, weights, begins).astype("<u4")
            sums = np.add.reduceat(weights, begins)
            for d, row, w, df in zip(who[begins], buckets_of(samples, choices), sums, np.split(held, begins[1:]), strict=True):
                found[start + d], total[start + d], seen[start + d] = row, float(w), zlib.compress(df.tobytes(), 1)
        return pd.DataFrame({"doc_id": batch["doc_id"], "key": batch["key"], "weight": total, "seen": seen, "buckets": found}).astype({"doc_id": "Int64", "weight": "Float64"})

    def sign_leanly(batch: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = sign(batch, answers)
        release()
        return out

    both = chunks.select("chunk", "doc_id", "key", "text").groupBy("chunk").cogroup(document_frequencies(chunks).groupBy("chunk"))
    return both.applyInPandas(sign_leanly, "doc_id long, key string, weight double, seen binary, buckets array<long>")


def weighed(shingler: Shingler, text: str, seen: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, counts and weights of one of each shingle of a text with the frequencies ``seen``, among ``n`` documents."""
    _, hashes, tf = shingler.shingles([text])
    return hashes, tf, idf(np.frombuffer(zlib.decompress(seen), "<u4"), n)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two weighted sets (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = np.minimum(a[1][i], b[1][j]).sum()
    whole = a[1].sum() + b[1].sum() - low
    return float(low / whole) if whole > 0 else 1.0


def verified(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """a, b and the weighted Jaccard similarity of each pair of keys (a, b). ``texts``: key, text, seen, one row a key."""
    left = pairs.join(texts.select(F.col("key").alias("ka"), F.col("text").alias("ta"), F.col("seen").alias("sa")).hint("merge"), F.col("a") == F.col("ka")).select("a", "b", "ta", "sa")
    both = left.join(texts.select(F.col("key").alias("kb"), F.col("text").alias("tb"), F.col("seen").alias("sb")).hint("merge"), F.col("b") == F.col("kb")).select("a", "b", "ta", "sa", "tb", "sb")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        last: tuple[str | None, tuple] = (None, ())

        def weights(text: str, seen: bytes) -> tuple[np.ndarray, np.ndarray]:
            hashes, tf, unit = weighed(shingler, text, seen, n)
            return hashes, tf * unit

        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if last[0] != r.b:
                    last = (r.b, weights(r.tb, r.sb))
                out.append(weighted_jaccard(weights(r.ta, r.sa), last[1]))
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": out})

    return both.mapInPandas(lean(compare), "a string, b string, similarity double")


def overlaps(who: np.ndarray, hashes: np.ndarray, tf: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """The weight that each two of ``n`` sets share, from (set, hash, count, weight of one) of their elements."""
    out = np.zeros(n * n)
    _, at, many = np.unique(hashes, return_inverse=True, return_counts=True)
    both = many[at] > 1
    who, at, tf, unit = who[both], at[both], tf[both], unit[both]
    if not len(who):
        return out.reshape(n, n)
    # The k-th occurrence is an element of its own, so the minimum of two counts is a number of common elements.
    level = np.arange(tf.sum()) - np.repeat(np.cumsum(tf) - tf, tf)
    who, at, unit = np.repeat(who, tf), np.repeat(at, tf), np.repeat(unit, tf)
    order = np.lexsort((who, level, at))
    who, at, level, unit = who[order], at[order], level[order], unit[order]
    begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (level[1:] != level[:-1])]))
    sizes = np.diff(np.concatenate([begins, [len(who)]]))
    dense = sizes * 7 > n
    for size in np.unique(sizes[~dense & (sizes > 1)]):
        first = begins[~dense & (sizes == size)]
        step = max(1, CHUNK // int(size * size))
        for k in range(0, len(first), step):
            own = who[first[k : k + step, None] + np.arange(size)]
            pairs = own[:, :, None] * n + own[:, None, :]
            out += np.bincount(pairs.ravel(), np.repeat(unit[first[k : k + step]], size * size), minlength=n * n)
    out = out.reshape(n, n)
    wide = np.flatnonzero(dense & (sizes > 1))
    step = max(64, 2 * CHUNK // n)
    for k in range(0, len(wide), step):
        part = wide[k : k + step]
        held = np.zeros((n, len(part)))
        rows = np.repeat(begins[part] - np.cumsum(sizes[part]) + sizes[part], sizes[part]) + np.arange(sizes[part].sum())
        held[who[rows], np.repeat(np.arange(len(part)), sizes[part])] = 1
        out += (held * unit[begins[part]]) @ held.T
    return out


def linked(shared: np.ndarray, weights: np.ndarray, roots: list[str], similarity: float) -> list[tuple[int, int]]:
    """Links that join the sets of different roots as all pairs of at least ``similarity`` do, none of them twice."""
    names, own = np.unique(np.array(roots, dtype=object), return_inverse=True)
    whole = weights[:, None] + weights[None, :] - shared
    a, b = np.nonzero((shared >= similarity * whole) & (own[:, None] < own[None, :]))
    _, first = np.unique(own[a] * len(names) + own[b], return_index=True)
    up, out = list(range(len(names))), []

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in zip(a[first].tolist(), b[first].tolist(), strict=True):
        x, y = top(own[i]), top(own[j])
        if x != y:
            up[x] = y
            out.append((i, j))
    return out


def blocks_of(rooted: DataFrame, size: int = BLOCK) -> DataFrame:
    """key, root, bucket, low, high: the blocks in which members (key, root, bucket) of buckets with several roots meet.

    Each two members of a bucket with different roots are in a common block. Members of
    a bucket's largest root, in parts of about ``size``, meet the parts of the others,
    which meet each other too: a member has a row for each part it meets, not for each member.
    """
    by_root = staged(rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n")), "dup-root-sizes")
    split = by_root.groupBy("bucket").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    split = split.select(F.col("bucket").alias("c"), F.col("top.root").alias("most"), F.ceil(F.col("top.n") / size).cast("long").alias("tops"), F.ceil((F.col("n") - F.col("top.n")) / size).cast("long").alias("others"))
    split = staged(split, "dup-split")
    inside = rooted.join(split, F.col("bucket") == F.col("c"))
    salt, none = F.xxhash64("key", "bucket"), F.lit(0).cast("long")
    in_top = F.col("root") == F.col("most")
    part = F.when(in_top, -1 - F.pmod(salt, F.col("tops"))).otherwise(F.pmod(salt, F.col("others")))
    met = F.sequence(F.when(in_top, none).otherwise(-F.col("tops")), F.col("others") - 1)
    dealt = inside.withColumn("part", part).withColumn("other", F.explode(met))
    return dealt.select("key", "root", "bucket", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))


def resolved(blocks: DataFrame, texts: DataFrame, n: int, similarity: float) -> DataFrame:
    """Links (a, b) between members of different roots in each block; all pairs of them are verified."""
    block = ["bucket", "low", "high"]
    held = blocks.join(texts.select(F.col("key").alias("k"), "text", "seen").hint("merge"), F.col("key") == F.col("k")).select(*block, "key", "root", "text", "seen")
    held = held.repartition(4 * partitions(blocks.sparkSession), *block).sortWithinPartitions(*block)

    def links(shingler: Shingler, rows: pd.DataFrame) -> list[tuple[str, str]]:
        """Of one block. Texts that are too long to be held together meet in smaller sets, each with each other."""
        cut = (np.cumsum(rows["text"].str.len().to_numpy()) // BLOCK_CHARS).tolist()
        sets = [part for _, part in rows.groupby(cut)]
        if len(sets) < 2:
            return links_of(shingler, rows)
        return [x for i, a in enumerate(sets) for b in sets[i + 1 :] for x in links_of(shingler, pd.concat([a, b]))]

    def links_of(shingler: Shingler, rows: pd.DataFrame) -> list[tuple[str, str]]:
        roots = rows["root"].tolist()
        if len(set(roots)) < 2:
            return []
        found = []
        for i, (text, seen) in enumerate(zip(rows["text"], rows["seen"], strict=True)):
            hashes, tf, unit = weighed(shingler, text, seen, n)
            found.append((np.full(len(hashes), i), hashes, tf, unit))
        who, hashes, tf, unit = (np.concatenate(x) for x in zip(*found, strict=True))
        keys = rows["key"].tolist()
        shared = overlaps(who, hashes, tf, unit, len(rows))
        return [(keys[i], keys[j]) for i, j in linked(shared, np.bincount(who, tf * unit, minlength=len(rows)), roots, similarity)]

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler()
        open_: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            out = []
            at = batch[block].to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)])).tolist()
            for start, end in zip(begins, [*begins[1:], len(batch)], strict=True):
                if open_ and tuple(open_[-1][block].iloc[-1]) != tuple(at[start]):
                    out += links(shingler, pd.concat(open_))
                    open_ = []
                open_.append(batch.iloc[start:end])
            yield pd.DataFrame(out, columns=["a", "b"])
        if open_:
            yield pd.DataFrame(links(shingler, pd.concat(open_)), columns=["a", "b"])

    return held.mapInPandas(lean(resolve), "a string, b string")


def components(links: DataFrame) -> DataFrame:
    """key and root (the smallest key it is linked with, over any number of links) for the keys of ``links`` (a, b)."""
    both = staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dup-links")
    roots = staged(both.groupBy(F.col("a").alias("key")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "dup-roots")
    while True:
        other = roots.select(F.col("key").alias("k"), F.col("root").alias("r"))
        # A key takes the smallest root among its neighbours, then that root's own root.
        near = both.join(other, F.col("b") == F.col("k")).groupBy("a").agg(F.min("r").alias("low"))
        near = near.select(F.col("a").alias("n"), "low")
        lower = roots.join(near, F.col("key") == F.col("n")).select("key", F.col("root").alias("old"), F.least("root", "low").alias("mid"))
        after = lower.join(other, F.col("mid") == F.col("k")).select("key", "old", F.least("mid", "r").alias("root"))
        after = staged(after, "dup-roots")
        changed = after.where("old <> root").limit(1).count()
        roots = after.select("key", "root")
        if not changed:
            return roots


def classes(documents: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each document (doc_id, text): doc_id, key, class_id, class_key, keep.

    ``key`` names the text; texts are in one class if links of at least ``similarity``
    connect them. class_id is the smallest doc_id of the class (null if it has none),
    class_key the key of the document with it, and ``keep`` marks that document: the one
    of its class that stays (repeated rows of it are all marked). A null text is an
    empty one; texts without words are alike only if they are equal. Other columns are
    not read. An empty table gives an empty result.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("key", F.md5("text"))
    texts = in_chunks(texts)
    total = texts.count()
    marks = staged(signed(texts, total, bands, rows), "dup-marks")
    # One node for each different text.
    nodes = staged(marks.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.min("seen").alias("seen"), F.min("weight").alias("weight"), F.min("buckets").alias("buckets")), "dup-nodes")
    members = nodes.select("key", "first_id", "weight", F.explode("buckets").alias("bucket"))
    shared = staged(members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dup-shared").select(F.col("bucket").alias("c"), "n")
    members = staged(members.join(shared, F.col("bucket") == F.col("c")).select("key", "first_id", "weight", "bucket", "n"), "dup-members")
    wanted = staged(members.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("degree")), "dup-wanted").select(F.col("key").alias("k"), F.col("first_id").alias("f"), "degree")
    # Neither side of the joins with texts has a bound, so neither is ever broadcast.
    read = texts.join(wanted.hint("merge"), (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("f"))).select("key", "text")
    seen = nodes.select(F.col("key").alias("k"), "seen").hint("merge")
    read = staged(read.dropDuplicates(["key"]).join(seen, F.col("key") == F.col("k")).select("key", "text", "seen"), "dup-texts")

    members = staged(members.join(wanted.select("k", "degree"), F.col("key") == F.col("k")).select("key", "weight", "bucket", "degree"), "dup-members")
    # Where texts share a passage and differ in the rest, the lightest is the likest to every other one.
    centres = members.groupBy("bucket").agg(F.max(F.struct("degree", "key")).alias("top"), F.min(F.struct("weight", "key")).alias("light"))
    centres = staged(centres.select(F.col("bucket").alias("c"), F.array_distinct(F.array("top.key", "light.key")).alias("centres")), "dup-centres")
    starred = members.join(centres, F.col("bucket") == F.col("c")).select("key", F.explode("centres").alias("centre")).where(F.col("key") != F.col("centre"))
    pairs = starred.select(F.greatest("key", "centre").alias("a"), F.least("key", "centre").alias("b")).distinct()
    tested = staged(verified(pairs, read, total), "dup-tested")
    roots = components(tested.where(F.col("similarity") >= similarity))

    # What shares a bucket and is not linked yet: all pairs of different components.
    label = roots.select(F.col("key").alias("k"), "root")
    rooted = members.join(label, F.col("key") == F.col("k"), "left").select("key", "bucket", F.coalesce("root", "key").alias("root"))
    blocks = staged(blocks_of(staged(rooted, "dup-rooted")), "dup-blocks")
    fresh = staged(resolved(blocks, read, total, similarity).distinct(), "dup-resolved")
    if fresh.limit(1).count():
        roots = components(tested.where(F.col("similarity") >= similarity).select("a", "b").unionByName(fresh))

    rooted = nodes.select("key", "first_id").join(roots.select(F.col("key").alias("k"), "root"), F.col("key") == F.col("k"), "left").select("key", "first_id", F.coalesce("root", "key").alias("root"))
    rooted = staged(rooted, "dup-rooted")
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "key"))
    tops = staged(rooted.groupBy(F.col("root").alias("r")).agg(best.alias("best")), "dup-tops")
    named = rooted.join(tops, F.col("root") == F.col("r")).select(F.col("key").alias("k"), F.col("best.first_id").alias("class_id"), F.col("best.key").alias("class_key"))
    named = staged(named, "dup-named")
    keep = (F.col("key") == F.col("class_key")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return marks.select("doc_id", "key").join(named, F.col("key") == F.col("k")).select("doc_id", "key", "class_id", "class_key", keep.alias("keep"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    found = classes(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "keep")
