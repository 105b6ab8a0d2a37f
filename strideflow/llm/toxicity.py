"""Toxicity: Levenshtein automata over a lexicon trie, weighed by context.

The lexicon is learnt from labelled documents: words that toxic ones hold and others do
not, and stems that such words share (a stem is a term with any ending). Words of a text
run through the automaton that is the intersection of the lexicon's trie with a
Levenshtein automaton, so that misspelt terms are found as well. Hits whose context window
shows quotation, by its marks or by words that the labels show to announce it, are counted
apart from the others. A logistic model, whose weights are all learnt, turns the counts
into a score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table, small_batches, staged, unit_hash

#: Labelled rows that the model is fitted on, at most (in expectation). All else is bounded by what these rows hold.
FIT_ROWS = 20_000
LEAST_DOCS = 3
FUZZY_FROM = 5
STEM_LENGTHS = (4, 5, 6)
CONTEXT = 6
THRESHOLD = 0.7
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»“”„‘’…–—¡¿"
OPENING, CLOSING = "\"“„«‘'", "\"”“»’'"
#: How much likelier a word that announces quotation stands before hits in documents of label 0 than in others, and in how many of them at least.
CUE_ODDS, CUE_DOCS = 5, 10
FEATURES = 6


class Automaton:
    """The lexicon's trie intersected with a Levenshtein automaton, made deterministic on demand.

    Terms may be misspelt; a stem has to be as it is and may have any ending, but not none.
    """

    ENDING = -1  # the node of what follows a stem

    def __init__(self, terms: list[str], stems: list[str] = (), edits: int = 1, fuzzy_from: int = FUZZY_FROM):
        self.next: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.stem: set[int] = set()
        terms_, stems_ = frozenset(terms), frozenset(stems)
        for term in sorted({*terms, *stems}):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.term.append(None)
                node = self.next[node][c]
            if term in stems_:
                self.stem.add(node)
            if term in terms_:
                self.term[node] = term
        self.edits, self.fuzzy_from = edits, fuzzy_from
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.accepts: list[tuple[int, str] | None] = []
        self.dead = self.state({})
        self.start = self.state({0: 0})

    def state(self, reached: dict[int, int]) -> int:
        """The number of a state: trie nodes with the fewest edits that reach them, closed under missing letters."""
        queue = list(reached.items())
        for node, e in queue:
            if e < self.edits and node != self.ENDING:
                for child in self.next[node].values():
                    if reached.get(child, 99) > e + 1:
                        reached[child] = e + 1
                        queue.append((child, e + 1))
        key = frozenset(reached.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            ends = [(e, self.term[n]) for n, e in key if n != self.ENDING and self.term[n] is not None and (e == 0 or len(self.term[n]) >= self.fuzzy_from)]
            if self.ENDING in reached:
                ends.append((0, ""))
            self.accepts.append(min(ends, default=None))
        return self.states[key]

    def move(self, at: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[at]:
            if node == self.ENDING or (e == 0 and node in self.stem):
                reached[self.ENDING] = 0
            if node == self.ENDING:
                continue
            child = self.next[node].get(c)
            if child is not None:
                reached[child] = min(e, reached.get(child, 99))
            if e < self.edits:
                for other in (node, *self.next[node].values()):  # an extra letter, a wrong letter
                    reached[other] = min(e + 1, reached.get(other, 99))
        found = self.moves[at][c] = self.state(reached)
        return found

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within the allowed edits; no edits and "" where only a stem is met."""
        at, dead, moves = self.start, self.dead, self.moves
        for c in word:
            to = moves[at].get(c)
            at = self.move(at, c) if to is None else to
            if at == dead:
                return None
        return self.accepts[at]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    stems: list[str] = field(default_factory=list)
    ordinary: list[str] = field(default_factory=list)  # near a term, but seen in texts that are not toxic
    cues: list[str] = field(default_factory=list)  # words that announce quotation
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))


class Scanner:
    """A model made ready for one task."""

    def __init__(self, model: Model):
        self.automaton = Automaton(model.terms, model.stems)
        self.ordinary, self.cues = frozenset(model.ordinary), frozenset(model.cues)
        self.known: dict[str, int | None] = {}

    def look(self, word: str) -> int | None:
        """The edits to the nearest term, if the word is a hit."""
        found = self.automaton.match(word)
        return None if found is None or (found[0] and word in self.ordinary) else found[0]

    def hits(self, words: list[str]) -> list[tuple[int, int]]:
        """(place, edits) of the words, as they stand in the text, that hit."""
        known = self.known
        if len(known) > 500_000:  # a bound for memory; never within a text
            known.clear()
        wanted = set()
        for raw in set(words):
            if raw not in known:
                known[raw] = self.look(raw.strip(EDGE))
            if known[raw] is not None:
                wanted.add(raw)
        return [(i, known[raw]) for i, raw in enumerate(words) if raw in wanted] if wanted else []

    def counts(self, text: str) -> np.ndarray:
        """Features of a text: 1, then log counts of exact and of misspelt hits, of the same where they are quoted, and the density of those that are not."""
        words = text.lower().split()
        met = [[0, 0], [0, 0]]  # by quotation, then by spelling
        for i, edits in self.hits(words):
            met[self.quoted(words, i)][edits > 0] += 1
        every = met[0][0] + 0.5 * met[0][1]
        return np.array([1.0, *(math.log1p(n) for own in met for n in own), 100 * every / (len(words) + 20)])

    def quoted(self, words: list[str], i: int) -> bool:
        """Whether the window around a word shows quotation."""
        before, after = words[max(0, i - CONTEXT) : i + 1], words[i : i + CONTEXT + 1]
        opened = any(w[0] in OPENING for w in before) and any(w[-1] in CLOSING or w.rstrip(".,;:!?")[-1:] in tuple(CLOSING) for w in after)
        return opened or any(w.strip(EDGE) in self.cues for w in before[:-1])


def word_counts(sample: DataFrame) -> DataFrame:
    """Of each word of the sample (text, toxic): documents with label 1, with label 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[str, list[int]] = {}
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for w in {raw.strip(EDGE) for raw in (text or "").lower().split()}:
                    found.setdefault(w, [0, 0])[1 - int(toxic)] += 1
            found.pop("", None)
            yield pd.DataFrame({"word": list(found), "pos": [v[0] for v in found.values()], "neg": [v[1] for v in found.values()]})

    return sample.select("text", "toxic").mapInPandas(count, "word string, pos long, neg long").groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def telling(counts: DataFrame, n_pos: int, n_neg: int, key: str) -> DataFrame:
    """Rows of counts that speak for label 1: twenty times likelier there, and by more than chance."""
    odds = (F.col("pos") / F.lit(max(n_pos, 1))) / ((F.col("neg") + 0.5) / F.lit(max(n_neg, 1)))
    fine = (F.col("pos") >= LEAST_DOCS) & (odds >= 20) & F.col(key).rlike(r"^\p{L}[\p{L}'-]+$") & (F.length(key) >= 3)
    return counts.where(fine).withColumn("gain", F.col("pos") * F.log(odds))


def learn(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model from rows (doc_id, text, toxic); null labels teach nothing.

    ``labelled`` should hold ``fit_rows`` rows at most; equal texts count once. Seven in ten
    rows, by a hash of the text, teach the lexicon, the others the weights (all rows, where
    the others lack a label). Without rows of both labels every text scores the same.
    """
    rows = labelled.where("toxic is not null").groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("key")).agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    rows = staged(rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(10))), "toxic-sample")
    for_terms = rows.where("part < 7")
    sizes = {r["toxic"]: r["n"] for r in for_terms.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    model = Model()
    if n_pos and n_neg:
        counts = staged(word_counts(for_terms), "toxic-words")
        model.terms = sorted(r["word"] for r in telling(counts, n_pos, n_neg, "word").select("word").collect())
        # Stems: what several telling words begin with, and no other words do.
        pieces = counts.select(F.explode(F.array_distinct(F.array(*[F.substring("word", 1, n) for n in STEM_LENGTHS]))).alias("stem"), "word", "pos", "neg").where(F.length("stem") < F.length("word"))
        stems = pieces.groupBy("stem").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum((F.col("pos") >= 2).cast("int")).alias("words"))
        model.stems = sorted(r["stem"] for r in telling(stems.where("words >= 3"), n_pos, n_neg, "stem").where("neg * 100 <= pos").select("stem").collect())
        automaton_terms = model.terms

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            automaton = Automaton(automaton_terms)
            for batch in batches:
                yield batch[[bool(m and m[0]) for m in map(automaton.match, batch["word"])]]

        # Bounded by the words within an edit of ``terms`` terms.
        seen = counts.where("neg > 0 and neg * 20 >= pos").select("word").mapInPandas(near, "word string")
        model.ordinary = sorted(r["word"] for r in seen.collect())

        model.cues = cue_words(for_terms, model)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model)
        for batch in batches:
            f = np.array([scanner.counts(t or "") for t in batch["text"]]).reshape(-1, FEATURES)
            yield pd.DataFrame({"toxic": batch["toxic"].astype(float), **{f"f{i}": f[:, i] for i in range(FEATURES)}})

    def measured(some: DataFrame) -> pd.DataFrame:
        """At most fit_rows rows."""
        return some.select("text", F.col("toxic").cast("double").alias("toxic")).mapInPandas(features, "toxic double, " + ", ".join(f"f{i} double" for i in range(FEATURES))).toPandas()

    if n_pos and n_neg:
        seen = measured(rows.where("part >= 7"))
        if seen["toxic"].nunique() < 2:
            seen = measured(rows)
        model.weights = logistic(seen[[f"f{i}" for i in range(FEATURES)]].to_numpy(), seen["toxic"].to_numpy())
    return model


def cue_words(sample: DataFrame, model: Model) -> list[str]:
    """Words in the windows before hits that are CUE_ODDS times likelier where the document's label is 0: they announce quotation."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model)
        for batch in batches:
            out = []
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                words = (text or "").lower().split()
                found = {words[j].strip(EDGE) for i, _ in scanner.hits(words) for j in range(max(0, i - CONTEXT), i)}
                out += [(w, int(toxic)) for w in {"", *found}] if scanner.hits(words) else []
            yield pd.DataFrame(out, columns=["word", "toxic"])

    met = sample.select("text", "toxic").mapInPandas(near, "word string, toxic int").groupBy("word").agg(F.sum("toxic").cast("long").alias("pos"), F.sum(1 - F.col("toxic")).cast("long").alias("neg"))
    met = staged(met, "toxic-cues")
    whole = met.where("word = ''").first()  # documents with hits
    if whole is None or not whole["neg"]:
        return []
    odds = (F.col("neg") / whole["neg"]) / ((F.col("pos") + 0.5) / (whole["pos"] + 1))
    return sorted(r["word"] for r in met.where((F.col("word") != "") & (F.col("neg") >= CUE_DOCS) & (odds >= CUE_ODDS)).select("word").collect())


def logistic(x: np.ndarray, y: np.ndarray, hold: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; hits never count against toxicity."""
    w = np.zeros(x.shape[1])
    ridge = hold * np.diag([0.01, *[1.0] * (x.shape[1] - 1)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), x.T @ (p - y) + ridge @ w)
        w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-7:
            break
    w[1:] = np.maximum(w[1:], 0.0)
    return w


def score(documents: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns in ``keep`` and the score, 0 to 1, of each whole text.

    Null and empty texts have no hits, and the score of a text without hits. Repeated rows
    get equal answers; an empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    slim = documents.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(model)
        for batch in batches:
            f = np.array([scanner.counts(t or "") for t in batch["__text"]]).reshape(-1, FEATURES)
            out = batch.drop(columns="__text")
            out["score"] = 1 / (1 + np.exp(-np.clip(f @ model.weights, -30, 30)))
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "__text"]
    return slim.mapInPandas(run, ", ".join([*fields, "score double"]))


def held_out(fold: int = 1, of: int = 3):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == fold, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """At most ``fit_rows`` (in expectation) labelled documents, chosen by a hash of doc_id."""
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, usable.count()))
    chosen = usable.where(unit_hash(F.col("doc_id"), F.lit("toxicity")) < share)
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # bounded by fit_rows


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learnt from labels that are not held out."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(labelled_sample(documents, read_table(spark, sf_dir, "labels").where(~held_out())))
    out = score(documents, model, keep=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
