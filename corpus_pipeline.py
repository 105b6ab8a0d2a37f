"""A corpus from raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
returns a DataFrame; all but the last return the columns of the documents they got,
whatever else those hold. ``run`` applies them, each written and read again.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideflow.llm import languages, mixing, near_duplicates, packing, secrets
from strideflow.llm.common import read_table, staged

#: A text whose best cosine is lower is in none of the known languages.
LEAST_LIKENESS = 0.1


def _numbered(docs: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The table under names that cannot clash, those names, and the number of each column's name."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), names, dict(zip(docs.columns, names, strict=True))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay: those without letters, or like no language, go.

    Prototypes are learnt from the rows with a lang, as the query of this operator does.
    Without any such row nothing can be judged and all rows stay. A null or empty text has
    no letters. Repeated rows are judged alike, ties go to the language that sorts first,
    and an empty table stays empty.
    """
    model = languages.learn(docs.select("doc_id", "text", "lang").where(~languages.held_out()))
    if not model[0]:
        return docs
    rows, names, at = _numbered(docs)
    judged = languages.predict(rows.withColumn("text", F.col(at["text"])), model, keep=names)
    kept = judged.where((F.col("lang_pred") != languages.UNKNOWN) & (F.col("score") >= LEAST_LIKENESS))
    return kept.select(*[F.col(n) for n in names]).toDF(*docs.columns)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: the one with the smallest doc_id.

    Null texts count as empty ones, and equal texts are one class, empty ones too. Null ids
    come after all others; of repeated rows of the document that stays, one stays. An empty
    table stays empty.
    """
    found = near_duplicates.classes(docs.select("doc_id", "text"))
    kept = staged(found.where("keep").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "pipeline-kept")
    rows, names, at = _numbered(docs)
    rows = rows.withColumn("text_key", F.md5(F.coalesce(F.col(at["text"]), F.lit(""))))
    named = kept.select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key"))
    out = rows.join(named, (F.col("text_key") == F.col("kept_key")) & F.col(at["doc_id"]).eqNullSafe(F.col("kept_id")), "left_semi")
    if kept.where("n > 1").limit(1).count():  # repeated rows of a document that stays: one is enough
        out = out.dropDuplicates([at["doc_id"], "text_key"])
    return out.select(*names).toDF(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts; n_chars follows, where there is such a column.

    Every row stays. Null texts stay null, and repeated rows are masked alike. An empty
    table stays empty.
    """
    rows, names, at = _numbered(docs)
    others = [n for n in names if n != at["text"]]
    out = secrets.scan(rows.withColumn("text", F.col(at["text"])), secrets.default_net(), keep=others, also=at["text"])
    if "n_chars" in at:
        changed = F.size("spans") > 0
        out = out.withColumn(at["n_chars"], F.when(changed, F.length(at["text"])).otherwise(F.col(at["n_chars"])).cast(docs.schema["n_chars"].dataType))
    return out.select(*names).toDF(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from never to twice.

    A null source is a source, named last. Texts without words, null ones too, share the
    fate of the block they lie in. Repeated rows each have a place of their own. An empty
    table stays empty.
    """
    rows, names, at = _numbered(docs)
    given = rows.select(*[F.col(n) for n in names], F.col(at["doc_id"]).alias("doc_id"), F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text"))
    sized = mixing.sized(given)
    slim = sized.withColumn("mix_row", F.struct(*[F.col(f"mix_row.{n}").alias(n) for n in names]))
    taken = mixing.mix(slim).where("mix_times > 0")
    repeated = taken.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("mix_times"))))
    return repeated.select(*[F.col(f"mix_row.{n}") for n in names]).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the training corpus: one row for each piece, with its place.

    A null text is an empty one, a piece of the end id alone. Repeated rows are packed each,
    ties between equal lengths are broken by a hash, and an empty table gives no pieces.
    """
    return packing.pack(staged(packing.tokenised(docs.select("doc_id", "text")), "pipeline-pieces"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicate),
    ("secrets", secret_scan),
    ("mixing", mixture),
    ("packing", pack),
]
#: Cosines, networks and tokenizers are not SQL; test_pipeline_stages_match_plain_versions holds every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
