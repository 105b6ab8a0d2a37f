"""Language identification with hyperdimensional profiles.

Every letter has a random vector of plus and minus ones. An n-gram is bound from its
letters' vectors, each permuted by its place, by elementwise multiplication; a text is the
bundle (sum) of its n-grams, and a language's prototype the bundle of its texts. A text
gets the language whose prototype has the highest cosine with the text's own vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, read_table, small_batches, staged, unit_hash

DIMENSIONS = 1024
SEED = 20
#: Rows of each language that prototypes are made from, at most (in expectation).
FIT_ROWS = 2000
UNKNOWN = "und"
#: Texts that one matrix product takes, and letters they have at most together (one text may have more).
CHUNK_ROWS, CHUNK_CHARS = 256, 1 << 20
#: Trigrams that are bound at a time.
BOUND = 4096


def letter_classes() -> np.ndarray:
    """A symbol for each code point: 0 for what is no letter, 1 to 26 for a to z, other letters' own code point in lower case."""
    table = np.zeros(0x110000, dtype=np.int32)
    points = np.array([i for i in range(0x110000) if chr(i).isalpha()], dtype=np.int64)
    lower = np.array([ord(low) if len(low := chr(p).lower()) == 1 else p for p in points], dtype=np.int64)
    table[points] = np.where((lower >= 97) & (lower <= 122), lower - 96, lower)
    return table


def letter_vectors(symbols: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of plus and minus ones for each symbol, drawn by mixing its number (splitmix64), so that no table holds all letters."""
    words = -(-dimensions // 64)
    x = (np.asarray(symbols, dtype=np.uint64)[:, None] << np.uint64(32)) + np.arange(words, dtype=np.uint64) + np.uint64(SEED << 56)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    bits = np.unpackbits(np.ascontiguousarray(x.astype("<u8")).view(np.uint8), axis=1)[:, :dimensions]
    return bits.astype(np.int8) * 2 - 1


class Letters:
    """Letters' vectors, permuted by a place, for one symbol or an array of them."""

    def __init__(self, place: int, dimensions: int):
        self.place, self.dimensions = place, dimensions

    def __getitem__(self, symbols):
        found, at = np.unique(np.atleast_1d(symbols), return_inverse=True)
        rows = np.roll(letter_vectors(found, self.dimensions), self.place, axis=1)[at]
        return rows if np.ndim(symbols) else rows[0]


class Encoder:
    """Texts to vectors, a chunk at a time."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.classes = letter_classes()
        self.first, self.second, self.third = (Letters(place, dimensions) for place in (2, 1, 0))
        self.dimensions = dimensions

    def grams(self, text: str) -> np.ndarray:
        """Numbers of the trigrams of a text, 21 bits a letter; a run of other characters is one boundary."""
        s = self.classes[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        if not s.any():
            return np.zeros(0, dtype=np.int64)
        s = np.concatenate([[0], s, [0]]).astype(np.int64)
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        s = s[keep]
        return (s[:-2] << 42) + (s[1:-1] << 21) + s[2:]

    def vectors(self, grams: list[np.ndarray]) -> np.ndarray:
        """One bundled vector for each text."""
        out = np.zeros((len(grams), self.dimensions), dtype=np.float32)
        counted = [np.unique(g, return_counts=True) for g in grams]
        numbers, times = np.concatenate([u for u, _ in counted]), np.concatenate([n for _, n in counted])
        rows = np.repeat(np.arange(len(grams)), [len(u) for u, _ in counted])
        order = np.argsort(numbers, kind="stable")
        numbers, times, rows = numbers[order], times[order], rows[order]
        used, first = np.unique(numbers, return_index=True)
        first = np.append(first, len(numbers))
        place = np.repeat(np.arange(len(used)), np.diff(first))
        for at in range(0, len(used), BOUND):
            u = used[at : at + BOUND]
            bound = (self.first[u >> 42] * self.second[(u >> 21) & 0x1FFFFF] * self.third[u & 0x1FFFFF]).astype(np.float32)
            here = slice(first[at], first[at + len(u)])
            counts = np.zeros((len(grams), len(u)), dtype=np.float32)
            counts[rows[here], place[here] - at] = times[here]
            out += counts @ bound
        return out


def chunks(texts: list[str | None], encoder: Encoder) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Trigrams of successive texts, few enough at a time to bound memory: first row, their trigrams."""
    start, kept, chars = 0, [], 0
    for i, text in enumerate(texts):
        if kept and (len(kept) == CHUNK_ROWS or chars + len(text or "") > CHUNK_CHARS):
            yield start, kept
            start, kept, chars = i, [], 0
        kept.append(encoder.grams(text or ""))
        chars += len(text or "")
    if kept:
        yield start, kept


def unit(vectors: np.ndarray) -> np.ndarray:
    norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return vectors / np.where(norms > 0, norms, 1)


def learn(examples: DataFrame, fit_rows: int = FIT_ROWS, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted) and their unit prototypes, from rows (doc_id, text, lang).

    Rows with a null lang or text teach nothing. Of a language with more than
    ``fit_rows`` rows, a part chosen by a hash of doc_id is used.
    """
    usable = examples.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    if not counts:
        return [], np.zeros((0, dimensions))
    share = F.element_at(F.create_map(*[x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, fit_rows / n)))]), F.col("lang"))
    sample = usable.where(unit_hash(F.col("doc_id"), F.lit("language")) < share)

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(dimensions)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch["lang"].tolist()
            for start, grams in chunks(batch["text"].tolist(), encoder):
                for lang, v in zip(langs[start : start + len(grams)], unit(encoder.vectors(grams)), strict=True):
                    sums[lang] = sums.get(lang, 0) + v
        if sums:
            yield pd.DataFrame({"lang": list(sums), "bundle": [v.astype("<f8").tobytes() for v in sums.values()]})

    parts = sample.select("text", "lang").mapInPandas(lean(bundle), "lang string, bundle binary")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, raw in zip(batch["lang"], batch["bundle"], strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(raw, "<f8")
        if sums:
            yield pd.DataFrame({"lang": list(sums), "bundle": [v.tobytes() for v in sums.values()]})

    found = {r["lang"]: np.frombuffer(bytes(r["bundle"]), "<f8") for r in parts.repartition(max(1, len(counts)), "lang").mapInPandas(add, "lang string, bundle binary").collect()}
    langs = sorted(found)
    prototypes = unit(np.array([found[k] for k in langs]).reshape(len(langs), -1))
    return langs, prototypes


def predict(documents: DataFrame, model: tuple[list[str], np.ndarray], keep: list[str]) -> DataFrame:
    """lang_pred and score of every whole text, beside the columns in ``keep``.

    A null text, a text without a letter and any text under a model without languages is
    ``und`` with score 0. Score is the cosine with the prototype, 0 where it is negative.
    Ties go to the language that sorts first. Repeated rows get equal answers.
    """
    langs, prototypes = model
    small_batches(documents.sparkSession)
    slim = documents.select(*keep, F.col("text").alias("__text"))

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(prototypes.shape[1])
        by_lang = prototypes.T.astype(np.float32)
        for batch in batches:
            texts = batch["__text"].tolist()
            found, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for start, grams in chunks(texts, encoder) if langs else ():
                cosine = unit(encoder.vectors(grams)) @ by_lang
                best = cosine.argmax(axis=1)
                for j, g in enumerate(grams):
                    if len(g):
                        found[start + j] = langs[best[j]]
                        scores[start + j] = min(1.0, max(0.0, float(cosine[j, best[j]])))
            out = batch.drop(columns="__text")
            out["lang_pred"], out["score"] = found, scores
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "__text"]
    return slim.mapInPandas(lean(answer), ", ".join([*fields, "lang_pred string", "score double"]))


def held_out(fold: int = 2, of: int = 4):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def op5_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the documents that are not held out."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(documents.where(~held_out()))
    answers = predict(documents.select("doc_id", "text"), model, keep=["doc_id"])
    return answers.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
