"""Secret scans: rules find candidates, a character convolutional network scores them.

Every span that a base rule finds is a secret. Long tokens that mix letters and digits are
candidates too; a small convolutional network, in numpy, reads each candidate whole, in
windows that overlap, each with its surrounding characters. A candidate has the highest
calibrated probability of its windows, and is added if that reaches a threshold. The
network is trained on labelled findings; its probabilities are calibrated (Platt) on
findings it was not trained on, and the threshold is the lowest there with a precision of
at least ``precision``, provided that recall is then at least ``recall``; else it is the
highest with that recall. It lies at the last secret that is found so.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, read_table, small_batches

KINDS = ("assign", "access", "hex", "net")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=.\-]{16,}")
#: Characters of a window before, in and after what it reads of a candidate, and from one window to the next.
BEFORE, WITHIN, AFTER = 16, 48, 8
STEP = 24
#: Windows that are scored together.
AT_ONCE = 8192
WIDTH = BEFORE + WITHIN + AFTER
#: Character classes: each of these by itself, then other lower, upper, digit, space, other.
OWN = "+/_=.-:\"'@,;()<>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind: what the rules find, leftmost and non-overlapping for each kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Long tokens with a letter and a digit that are not within one base span; those that only overlap one are read whole."""
    out, k = [], 0
    by_start = sorted((s, e) for _, s, e in base)
    furthest = 0
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while k < len(by_start) and by_start[k][0] <= start:
            furthest = max(furthest, by_start[k][1])
            k += 1
        token = m.group()
        if furthest < end and any(c.isdigit() for c in token) and any(c.isalpha() for c in token):
            out.append((start, end))
    return out


def char_classes() -> np.ndarray:
    table = np.full(256, 1, dtype=np.uint8)
    for i, c in enumerate(OWN):
        table[ord(c)] = 7 + i
    for c in "abcdef":
        table[ord(c)] = 2
    for c in string.ascii_lowercase[6:]:
        table[ord(c)] = 3
    for c in string.ascii_uppercase:
        table[ord(c)] = 4
    for c in string.digits:
        table[ord(c)] = 5
    for c in " \t\r\n":
        table[ord(c)] = 6
    return table


def places(start: int, end: int) -> list[tuple[int, int]]:
    """What the windows of a candidate read of it: parts of up to WITHIN characters, STEP apart, to its end."""
    return [(at, min(end, at + WITHIN)) for at in range(start, max(start + 1, end - WITHIN + STEP), STEP)]


def windows(text: str, spans: list[tuple[int, int]], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class numbers of each window of the candidates (0 where there is nothing), and the candidate of each."""
    codes = np.concatenate([np.zeros(BEFORE, np.uint8), table[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)], np.zeros(WITHIN + AFTER, np.uint8)])
    read = [(i, a, b) for i, span in enumerate(spans) for a, b in places(*span)]
    owner, first, stop = np.array(read, dtype=np.int64).reshape(-1, 3).T
    out = np.zeros((len(read), WIDTH), dtype=np.uint8)
    inner = np.arange(WITHIN)
    out[:, :BEFORE] = codes[first[:, None] + np.arange(BEFORE)]
    out[:, BEFORE : BEFORE + WITHIN] = np.where(inner < (stop - first)[:, None], codes[first[:, None] + BEFORE + inner], 0)
    out[:, BEFORE + WITHIN :] = codes[stop[:, None] + BEFORE + np.arange(AFTER)]
    return out, owner


@dataclass
class CharNet:
    """Embedding, one convolution, max pooling over the candidate and over its context, logistic output."""

    embed: np.ndarray
    kernel: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    shift: float
    scale: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5

    TAPS = 5

    @classmethod
    def fresh(cls, seed: int, classes: int = 7 + len(OWN), depth: int = 8, filters: int = 24) -> CharNet:
        r = np.random.default_rng(seed)
        return cls(r.normal(0, 0.5, (classes, depth)), r.normal(0, 0.2, (cls.TAPS * depth, filters)), np.zeros(filters), r.normal(0, 0.1, 2 * filters), 0.0)

    def forward(self, x: np.ndarray) -> tuple:
        e = self.embed[x]
        n, w, d = e.shape
        cols = np.concatenate([e[:, i : w - self.TAPS + 1 + i] for i in range(self.TAPS)], axis=2)
        h = np.maximum(cols @ self.kernel + self.bias, 0)
        inner = np.zeros(h.shape[1], dtype=bool)
        inner[BEFORE : BEFORE + WITHIN - self.TAPS + 1] = True
        a, b = h[:, inner], h[:, ~inner]
        pooled = np.concatenate([a.mean(axis=1), b.max(axis=1)], axis=1)
        return cols, h, inner, pooled, pooled @ self.out + self.shift

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for at in range(0, len(x), 1024):
            out[at : at + 1024] = self.forward(x[at : at + 1024])[-1]
        return out

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -40, 40)))

    def probability(self, text: str, spans: list[tuple[int, int]], table: np.ndarray) -> np.ndarray:
        """Of each span: the highest calibrated probability of its windows."""
        best = np.full(len(spans), -np.inf)
        x, owner = windows(text, spans, table)
        np.maximum.at(best, owner, self.logits(x))
        return self.calibrated(best)

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.01, batch: int = 128) -> None:
        r = np.random.default_rng(seed)
        names = ("embed", "kernel", "bias", "out")
        m, v, t = {k: 0.0 for k in (*names, "shift")}, {k: 0.0 for k in (*names, "shift")}, 0
        for _ in range(epochs):
            for at in np.array_split(r.permutation(len(x)), max(1, len(x) // batch)):
                xb, yb = x[at], y[at]
                cols, h, inner, pooled, z = self.forward(xb)
                dz = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - yb) / len(xb)
                grad = {"out": pooled.T @ dz, "shift": dz.sum()}
                dp = dz[:, None] * self.out[None, :]
                f = h.shape[2]
                dh = np.zeros_like(h)
                dh[:, inner] = dp[:, None, :f] / inner.sum()
                context = np.flatnonzero(~inner)
                top = context[h[:, context].argmax(axis=1)]
                np.put_along_axis(dh, top[:, None, :], np.take_along_axis(dh, top[:, None, :], 1) + dp[:, None, f:], 1)
                dh *= h > 0
                grad["kernel"], grad["bias"] = np.tensordot(cols, dh, ((0, 1), (0, 1))), dh.sum(axis=(0, 1))
                dcols = dh @ self.kernel.T
                d = self.embed.shape[1]
                grad["embed"] = np.zeros_like(self.embed)
                for i in range(self.TAPS):
                    np.add.at(grad["embed"], xb[:, i : xb.shape[1] - self.TAPS + 1 + i], dcols[:, :, i * d : (i + 1) * d])
                t += 1
                for k, g in grad.items():
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g**2
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8))


def labelled_findings(n: int = 3000, seed: int = 9) -> pd.DataFrame:
    """Made findings (text, start, end, label): half secrets of many shapes, half long tokens that are none."""
    r = random.Random(seed)
    alnum, b64 = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"

    def word(low: int = 3, high: int = 9) -> str:
        return "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(low, high)))

    def of(chars: str, low: int, high: int) -> str:
        return "".join(r.choice(chars) for _ in range(r.randint(low, high)))

    secrets = (
        lambda: of(b64, 24, 64) + "=" * r.randint(0, 2),
        lambda: of(alnum, 20, 48),
        lambda: of(alnum + "-_", 24, 48),
        lambda: r.choice(("ghp_", "sk-", "pk_live_", "xoxb-", "glpat-")) + of(alnum, 20, 40),
        lambda: of("0123456789ABCDEF", 24, 64),
        lambda: base64.urlsafe_b64encode(f'{{"alg":"{word()}{r.random()}"}}'.encode()).decode().strip("=") + "." + of(alnum + "-_", 20, 30) + "." + of(alnum + "-_", 20, 40),
        lambda: of(alnum, 16, 22) + r.choice("+/=") + of(alnum, 4, 8),
    )
    plain = (
        lambda: f"{word()}{r.randint(0, 99)}.{word()}.{r.choice(('com', 'org', 'net', 'example.com'))}",
        lambda: f"{word()}-{word()}-{word()}-{r.randint(1, 2030)}",
        lambda: f"{word()}_{word()}_{word()}_{r.randint(0, 99)}",
        lambda: f"/{word()}/{word()}/{word()}{r.randint(0, 9)}.{r.choice(('py', 'txt', 'html', 'csv'))}",
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}T{r.randint(0, 23):02}.{r.randint(0, 59):02}.{r.randint(0, 59):02}Z",
        lambda: f"{word(5, 12)}{word(4, 9)}{r.randint(0, 999)}",
        lambda: f"v{r.randint(0, 20)}.{r.randint(0, 20)}.{r.randint(0, 200)}-{word()}.{r.randint(0, 9)}",
        lambda: f"{r.randint(1, 9)}{word()}.....{word()}....",
        lambda: f"{word().title()}{word().title()}{word().title()}{r.randint(1, 99)}",
        lambda: f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}x{r.randint(1, 99)}-{word(2, 3)}",
        lambda: "=" * r.randint(8, 20) + f"{word()}{r.randint(0, 9)}" + "=" * r.randint(4, 20),
    )
    runs = (  # what may stand around a secret in one token, or without one
        lambda: "".join(f"/{word()}" for _ in range(r.randint(2, 14))) + "/",
        lambda: "=".join(word() for _ in range(r.randint(2, 8))) + "=",
        lambda: f"{word()}.{word()}.{word(2, 3)}/" + "/".join(word() for _ in range(r.randint(1, 10))) + f"/v{r.randint(1, 9)}/",
    )
    hints = ("key: ", "secret ", "credentials=", "Authorization: Bearer ", "auth ", "use ")
    rows = []
    for i in range(n):
        label = i % 2
        head = r.choice(runs)() if r.random() < 0.25 else ""
        token = r.choice(secrets if label else plain)()
        left = " ".join(word(2, 8) for _ in range(r.randint(0, 5))) + r.choice((" ", "\n", " (", ' "', ", "))
        left += r.choice(hints) if label and r.random() < 0.4 else ""
        right = r.choice((" ", "\n", ") ", '" ', ", ", ". ")) + " ".join(word(2, 8) for _ in range(r.randint(0, 3)))
        end = len(left) + len(head) + len(token)
        rows.append((left + head + token + right, len(left), end, label, len(left) + len(head) if label else end))
    return pd.DataFrame(rows, columns=["text", "start", "end", "label", "secret"])


def train(findings: pd.DataFrame, recall: float = 0.97, precision: float = 0.995, epochs: int = 8, seed: int = 9) -> CharNet:
    """A calibrated network from labelled findings (text, start, end, label, secret: where in it the secret begins).

    Three quarters train it, a quarter calibrates it and sets the threshold. A window is a
    positive example if it reads at least half of the secret or 16 characters of it, and none if it reads less.
    """
    table = char_classes()
    part = np.array([hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()[0] % 4 == 0 for t in findings["text"]])
    xs, ys = [], []
    for f in findings[~part].itertuples():
        x, _ = windows(f.text, [(f.start, f.end)], table)
        read = np.array([max(0, b - max(a, f.secret)) for a, b in places(f.start, f.end)])
        enough = read >= min(16, (f.end - f.secret + 1) // 2)
        use = enough | (read == 0) if f.label else np.ones(len(x), dtype=bool)
        xs.append(x[use])
        ys.append((enough & bool(f.label))[use])
    net = CharNet.fresh(seed)
    net.train(np.concatenate(xs), np.concatenate(ys).astype(float), epochs, seed)
    held = findings[part]
    found = [windows(f.text, [(f.start, f.end)], table)[0] for f in held.itertuples()]
    z = np.maximum.reduceat(net.logits(np.concatenate(found)), np.cumsum([0, *map(len, found)])[:-1])
    t = held["label"].to_numpy(float)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of the calibrating logistic regression, lightly held to 1 and 0
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((p - t) * z).sum() + (a - 1) * 0.1, (p - t).sum() + b * 0.1])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    net.scale, net.offset = float(a), float(b)
    p = net.calibrated(z)
    order = np.argsort(-p)
    right = np.cumsum(t[order])
    best = np.flatnonzero(right / np.arange(1, len(p) + 1) >= precision)  # where to cut, from the surest down
    least = int(np.searchsorted(right, recall * t.sum()))  # the first cut with enough recall
    cut = max(best.max(initial=0), min(least, len(p) - 1))
    sure = order[: cut + 1]
    net.threshold = float(p[sure][t[sure] > 0].min(initial=1.0))
    return net


SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def scan(documents: DataFrame, net: CharNet, keep: list[str], also: str | None = None) -> DataFrame:
    """The columns in ``keep`` and ``spans``: all secrets of each whole text, by start, then kind.

    Base spans have the network's probability as score and stay whatever it is; others are
    of kind ``net`` and may overlap a base span that is a part of them. A null or empty
    text has no spans. Places are code points, ends exclusive. ``also`` names a column to
    return the text in, its secrets masked (null stays null). Repeated rows get equal
    answers; an empty table gives an empty result.
    """
    small_batches(documents.sparkSession)
    slim = documents.select(*keep, F.col("text").alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = char_classes()

        def scored(some: list[tuple[int, list, np.ndarray, np.ndarray]], best: dict[int, np.ndarray]) -> None:
            if some:
                z = net.logits(np.concatenate([x for _, _, x, _ in some]))
                at = 0
                for i, spans, x, owner in some:
                    top = np.full(len(spans), -np.inf)
                    np.maximum.at(top, owner, z[at : at + len(x)])
                    best[i], at = net.calibrated(top), at + len(x)

        for batch in batches:
            texts = [t or "" for t in batch["__text"]]
            spans: list[list] = []
            best: dict[int, np.ndarray] = {}
            some: list[tuple[int, list, np.ndarray, np.ndarray]] = []
            for i, text in enumerate(texts):
                base = base_spans(text)
                spans.append(base + [("net", s, e) for s, e in candidates(text, base)])
                if spans[-1]:
                    some.append((i, spans[-1], *windows(text, [(s, e) for _, s, e in spans[-1]], table)))
                if sum(len(x) for _, _, x, _ in some) > AT_ONCE:
                    scored(some, best)
                    some = []
            scored(some, best)
            kept = []
            for i, found in enumerate(spans):
                rows = [(k, s, e, float(p)) for (k, s, e), p in zip(found, best.get(i, ()), strict=True) if k != "net" or p >= net.threshold]
                kept.append(sorted(rows, key=lambda r: (r[1], KINDS.index(r[0]), r[2])))
            out = batch.drop(columns="__text")
            if also:
                out[also] = [None if raw is None else masked(raw, [(s, e) for _, s, e, _ in rows]) for raw, rows in zip(batch["__text"], kept, strict=True)]
            out["spans"] = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in rows] for rows in kept]
            yield out

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "__text"]
    fields += [f"`{also}` string"] if also else []
    return slim.mapInPandas(lean(run), ", ".join([*fields, f"spans {SPANS}"]))


def masked(text: str, spans: list[tuple[int, int]], by: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by ``by``."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], by]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def default_net() -> CharNet:
    return train(labelled_findings())


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    """All secrets of all documents."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(documents, default_net(), keep=["doc_id"])
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "net")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
