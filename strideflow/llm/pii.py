"""Personal data by rules and bootstrapped contextual extraction. DataFrame functions only.

Four rules find e-mail addresses, IPv4 addresses, card and phone numbers. These are the
seeds: the words on either side of them induce lexical patterns ("a token after the word
tel"). A bipartite graph joins patterns and the identifier-like tokens (those with a digit
or an @) that fill them. A pattern speaks by what fills it: known identifiers are for it,
plain words against it, tokens not known yet hardly count; a token's score is the noisy-or
of its patterns'. Tokens above a bar join the known ones and the graph is scored again,
until nothing is added, so that high-confidence patterns discover identifiers that no rule
describes, and those induce patterns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read_table, staged, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: The rules, written so that the JVM finds the same matches without recursion or repeated scans: what is
#: possessive is followed by nothing that it could give back, and look-behinds skip only starts that fail as well.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A token with a digit or an @, and what is cut from its ends.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
LEAD, TRAIL = r"^[^\p{L}\p{N}+@]+", r"[^\p{L}\p{N}]+$"
#: Distinct known identifiers that a pattern needs, and what its score and a token's must reach.
LEAST_SEEDS = 3
PATTERN_BAR = 0.6
TOKEN_BAR = 0.9
#: What a token that is not known yet weighs against a pattern, beside the plain word's 1.
UNKNOWN = 0.01
#: Items that a running value goes through at once; arrays are copied within such a run only.
RUN = 256

_found = "array<struct<start:bigint,end:bigint,hit:string,left:string,right:string>>"


def bound(name: str, value: str, body: str) -> str:
    """SQL of ``body`` with ``value`` computed once, as ``name``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running(items: str, zero: str, step: str, body: str) -> str:
    """SQL of ``body`` with the running values of an array: ``at(i)`` in it stands for the value up to item i.

    ``step`` combines (a, b), as + and greatest do. Runs of RUN items and then the runs
    themselves are gone through, so that long arrays take little more than linear time.
    """
    along = lambda xs, x: f"aggregate({xs}, array({zero}), (acc, x) -> array_append(acc, {step.format(a='element_at(acc, -1)', b=x)}))"
    inner = f"transform(sequence(0, (size({items}) - 1) div {RUN}), r -> {along(f'slice({items}, r * {RUN} + 1, {RUN})', 'x')})"
    value = lambda i: step.format(a=f"run.c[({i}) div {RUN}]", b=f"run.w[({i}) div {RUN}][({i}) % {RUN} + 1]")
    out = []
    for k, part in enumerate(body.split("at(")):
        if k:
            i, _, rest = part.partition(")")
            part = f"({value(i)}){rest}"
        out.append(part)
    return bound("w", inner, bound("run", f"named_struct('w', w, 'c', {along('w', 'element_at(x, -1)')})", "".join(out)))


def matches(pattern: str, text: str = "__text") -> Column:
    """All matches of a pattern: start, end (code points, exclusive), the hit and the words beside it.

    Splitting at the pattern gives what lies between the hits; running lengths give places.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    word = "'^\\\\P{L}*+(\\\\p{L}++)', 1"
    each = f"""transform(z.h, (h, i) -> named_struct(
      'start', at(i) - length(h), 'end', at(i), 'hit', h,
      'left', lower(reverse(regexp_extract(reverse(z.g[i]), {word}))), 'right', lower(regexp_extract(z.g[i + 1], {word}))))"""
    placed = bound("l", "transform(z.h, (h, i) -> cast(length(z.g[i]) + length(h) as bigint))", running("l", "0L", "{a} + {b}", each))
    found = bound("z", f"named_struct('h', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1))", placed)
    return F.expr(f"CASE WHEN {text} RLIKE {p} THEN cast({found} AS {_found}) ELSE cast(array() AS {_found}) END")


def apart(tokens: str, spans: str) -> Column:
    """The tokens (by start, none overlapping another) that overlap none of the spans, in one pass over both sorted together."""
    item = lambda x, kind: f"named_struct('start', {x}.start, 'kind', {kind}, 'end', {x}.end, 'hit', {x}.hit, 'left', {x}.left, 'right', {x}.right)"
    both = f"array_sort(concat(transform({spans}, x -> {item('x', 0)}), transform({tokens}, x -> {item('x', 1)})))"
    last, first = "if(x.kind = 0, x.end, 0L)", f"if(x.kind = 0, x.start, {1 << 62}L)"
    free = "filter(s, (x, i) -> x.kind = 1 AND e[i] <= x.start AND b[size(s) - 1 - i] >= x.end)"
    along = lambda xs, zero, step, x: bound("q", f"transform({xs}, x -> {x})", running("q", zero, step, "transform(q, (x, i) -> at(i))"))
    ends, starts = along("s", "0L", "greatest({a}, {b})", last), along("reverse(s)", f"{1 << 62}L", "least({a}, {b})", first)
    kept = bound("s", both, bound("e", ends, bound("b", starts, free)))
    return F.expr(f"CASE WHEN size({spans}) > 0 AND size({tokens}) > 0 THEN transform({kept}, x -> named_struct('start', x.start, 'end', x.end, 'hit', x.hit, 'left', x.left, 'right', x.right)) ELSE {tokens} END")


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") * 2 / 10).cast("int"))
    reversed_digits = F.regexp_extract_all(F.reverse(number), F.lit("[0-9]"), F.lit(0))
    return F.aggregate(F.transform(reversed_digits, value), F.lit(0), lambda a, b: a + b.cast("int")) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return hit.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    n = F.length(digits(hit))
    if kind == "card":
        return F.when(n.between(13, 19), luhn(digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def based(documents: DataFrame) -> DataFrame:
    """doc_id, key (of the text), base (spans by kind and start, with the words beside them) and tokens (the others)."""
    rows = documents.select("doc_id", text_or_empty().alias("__text"))
    for kind in KINDS:
        rows = rows.withColumn(f"m_{kind}", matches(PATTERNS[kind]))
    def seeds(k: int, kind: str) -> Column:
        kept = F.filter(f"m_{kind}", lambda m: valid(kind, m["hit"]))
        return F.transform(kept, lambda m: F.struct(F.lit(k).alias("kind"), *[m[c].alias(c) for c in ("start", "end", "hit", "left", "right")]))

    each = [seeds(k, kind) for k, kind in enumerate(KINDS)]
    rows = rows.withColumn("base", F.concat(*each)).withColumn("m_token", matches(TOKEN))

    def trimmed(m: Column) -> Column:
        lead = F.length(m["hit"]) - F.length(F.regexp_replace(m["hit"], LEAD, ""))
        core = F.regexp_replace(F.regexp_replace(m["hit"], LEAD, ""), TRAIL, "")
        start = m["start"] + lead
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("hit"), m["left"].alias("left"), m["right"].alias("right"))

    rows = rows.withColumn("m_token", F.filter(F.transform("m_token", trimmed), lambda t: t["end"] > t["start"]))
    return rows.select("doc_id", F.md5("__text").alias("key"), "base", apart("m_token", "base").alias("tokens"), "__text")


def edges(rows: DataFrame, column: str, known: int) -> DataFrame:
    """Pattern-instance edges with their number of occurrences."""
    one = rows.select(F.explode(column).alias("t"))
    sides = F.array(F.struct(F.lit("L").alias("side"), F.col("t.left").alias("word")), F.struct(F.lit("R").alias("side"), F.col("t.right").alias("word")))
    return (
        one.select(F.lower("t.hit").alias("instance"), F.explode(sides).alias("p"))
        .where("p.word <> ''")
        .groupBy("p.side", "p.word", "instance")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("known", F.lit(float(known)))
    )


def discovered(graph: DataFrame, words: DataFrame) -> DataFrame:
    """Instances that the graph makes known, with their scores: instance, score.

    ``graph``: side, word, instance, n, known (1.0 for seeds); ``words``: word, total. A
    pattern's score is what known instances fill of all that speaks for or against it:
    its known fillings by their belief, one doubt, the plain words beside its word, and a
    little of the tokens not known yet. Beliefs only grow, so the rounds come to an end.
    """
    patterns = graph.groupBy("side", "word").agg(F.sum("n").alias("filled"))
    # An inner join with distinct words: a semi-join would be pushed below the count, and every word shuffled.
    totals = words.join(graph.select(F.col("word").alias("w")).distinct(), F.col("word") == F.col("w")).select("w", "total")
    plain = F.greatest(F.col("total") - F.col("filled"), F.lit(0))
    doubts = patterns.join(totals, F.col("word") == F.col("w")).select(F.col("side").alias("s"), F.col("word").alias("w"), "filled", plain.alias("plain"))
    doubts = staged(doubts, "pii-doubts")
    state = graph.withColumn("belief", F.col("known"))
    before = 0
    while True:
        believed = state.where("belief > 0").groupBy("side", "word").agg(F.sum(F.col("n") * F.col("belief")).alias("for"), F.sum("n").alias("met"), F.count(F.lit(1)).alias("seeds"))
        speaking = believed.where(F.col("seeds") >= LEAST_SEEDS).join(doubts, (F.col("side") == F.col("s")) & (F.col("word") == F.col("w")))
        score = F.col("for") / (F.col("for") + 1 + F.col("plain") + UNKNOWN * (F.col("filled") - F.col("met")))
        strong = staged(speaking.select("s", "w", score.alias("p")).where(F.col("p") >= PATTERN_BAR), "pii-patterns")
        fills = graph.where("known = 0").join(strong, (F.col("side") == F.col("s")) & (F.col("word") == F.col("w")))
        found = fills.groupBy("instance").agg((1 - F.exp(F.sum(F.log(1 - F.col("p"))))).alias("score")).where(F.col("score") >= TOKEN_BAR)
        found = staged(found, "pii-found")
        n = found.count()
        if n == before:
            return found
        before = n
        named = found.select(F.col("instance").alias("i"), "score")
        state = graph.join(named, F.col("instance") == F.col("i"), "left").withColumn("belief", F.when(F.col("known") == 1, 1.0).otherwise(F.coalesce("score", F.lit(0.0)))).drop("i", "score")


def personal(documents: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end; base kinds as listed, then ``context``, each by start) of every whole text.

    A null or empty text has no spans. Places are code points, ends exclusive. Repeated
    rows get equal answers; texts share their discoveries; a null doc_id is kept. An empty
    table gives an empty result. Other columns are not read.
    """
    rows = staged(based(documents).drop("__text"), "pii-rows")
    words = documents.select(F.explode(F.regexp_extract_all(F.lower(text_or_empty()), F.lit(r"\p{L}+"), F.lit(0))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("total"))
    graph = staged(edges(rows, "base", 1).unionByName(edges(rows, "tokens", 0)), "pii-graph")
    found = discovered(graph, words)
    tokens = rows.select("key", F.explode("tokens").alias("t")).select("key", F.lower("t.hit").alias("instance"), "t.start", "t.end")
    hits = tokens.join(found.select(F.col("instance").alias("i")), F.col("instance") == F.col("i"))
    by_text = hits.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end"))).alias("more"))
    by_text = staged(by_text, "pii-hits").withColumnRenamed("key", "k")
    plain = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end")))
    joined = rows.select("doc_id", "key", plain.alias("plain")).join(by_text, F.col("key") == F.col("k"), "left")
    return joined.select("doc_id", F.when(F.col("more").isNull(), F.col("plain")).otherwise(F.concat("plain", "more")).alias("spans"))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data of all documents."""
    found = personal(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in (*KINDS, "context")])
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    count = lambda k, name: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}")
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return found.select("doc_id", *[count(k, n) for k, n in enumerate((*KINDS, "context"))], F.size("spans").cast("long").alias("n_spans"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
