"""A corpus pipeline: language ID, toxicity, near duplicates, decontamination, packing.

Each stage takes all that the stage before it kept and returns the columns of
``documents``; the last one returns the pieces of the packed sequences.

* language_id: documents without a letter (``und``) go, those whose language isn't told
  apart from the next one's (a lead below ``LEAST_LEAD``: mixed texts), and, where
  ``LANGUAGES`` names some, those in other languages; None keeps every learned one.
* toxicity: documents with a score of 0.7 or more go; the field learns from the
  labels of the documents it is given.
* near_duplicates: of each component of the 5-word-shingle links at a similarity of
  0.8 or more, the document with the smallest id stays.
* decontamination: documents whose words are benchmark passages to a twentieth or
  more go.
* packing: the rest becomes sequences of 4096 ids in the sources' proportions.

Nulls, ties, repeated rows, empty tables and further columns are handled as the
operators' docstrings say; an empty table gives no pieces. What a stage has stored is
deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logtide.llm import common, decontamination, jaccard_join, language_id, packing, toxicity


#: Languages that stay (None: all that were learned), and how far ahead of the next one a document's language must be.
LANGUAGES: tuple[str, ...] | None = None
LEAST_LEAD = 0.01


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told, and wanted. Null and empty texts go; repeated rows stay repeated; an empty table stays empty."""
    out = language_id.predict(docs, language_id.learn_profiles(docs), carry=tuple(docs.columns))

    def told(df: DataFrame) -> DataFrame:
        df = df.where((df["lang_pred"] != language_id.UNKNOWN) & (df["score"] >= LEAST_LEAD))
        return df if LANGUAGES is None else df.where(df["lang_pred"].isin(*LANGUAGES))

    return _columns_behind(out, docs, told)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't predicted toxic. Null and empty texts stay, repeated rows too; without labels of both kinds all stay."""
    field = toxicity.fit_field(docs, common.table(spark, sf_dir, "labels"))
    out = toxicity.tag(docs, field, carry=tuple(docs.columns))
    return _columns_behind(out, docs, lambda df: df.where(df["predicted"] == 0))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id. Null and empty texts link with nothing and stay; of a repeated row one stays."""
    return jaccard_join.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated. Null and empty texts stay, repeated rows are judged alike; without a benchmark all stay."""
    out = decontamination.contamination(docs, common.table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return _columns_behind(out, docs, lambda df: df.where(~df["contaminated"]))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents. A null or empty text is its end id alone; repeated rows are packed as often; an empty table gives none."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), least=packing.LEAST)


def _columns_behind(out: DataFrame, docs: DataFrame, keep) -> DataFrame:
    """The carried columns, which stand last, of the rows that ``keep`` leaves; their names may clash with the operator's own."""
    n = len(docs.columns)
    carried = [f"_doc_{k}" for k in range(n)]
    return keep(out.toDF(*out.columns[:-n], *carried)).select(*carried).toDF(*docs.columns)


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The trained stages and the tokenizer can't be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with common.tidied() as keep:
            docs = keep(common.stored(stage(spark, docs, sf_dir)))
        if before is not None:
            common.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
