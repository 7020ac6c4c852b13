"""Predicates, validations and policies that guard data on its way; each is a column or a frame of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = ["NEGATIVE_CONTROL", "CONTEXTUAL", "SUPPORTING", "PRIMARY"]
#: What may not be in an argument, less separators; and paths as they are. Fixed values.
FORBIDDEN = "qrel qrels goldanswer answerkey relevantpage relevantpages holdout humanqrels humanqrelsfinal".split()
FORBIDDEN_PATHS = [r"(?i)/qrels?/", r"(?i)/gold[_.\-]?answers?/", r"(?i)/holdout/"]
#: Fields that a blinded item must not hold, and words that its routing reasons must not. Fixed values.
BLINDED = (
    "source_provenance raw_retrieval_unit generation_context_unit strategy retrieval_rank retrieval_score pre_rerank_rank post_rerank_rank selected_by_reranker "
    "dropped_by_reranker relevant_pages gold_answer confidence reasoning supporting_span judge_model judge_provider judge_id label_source"
).split()
REVEALING = "silver judge predicted low_confidence positive".split()
#: Characters that compatibility normalisation leaves as they are, whatever stands beside them: ASCII, and letters
#: and signs of Latin-1 and Latin Extended-A without a compatibility form.
INERT = "\u0000-\u009f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e"


def role_of(grade: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, ROLES)), grade.cast("int") + 1)


def no_holdout(qid: Column) -> Column:
    return ~F.contains(F.lower(qid), F.lit("holdout"))


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """df with column in Unicode's compatibility form (NFKC).

    Only rows with a character that may change go through Python; the others, and nulls, stay in the JVM.
    """
    import unicodedata

    import pyarrow as pa

    may_change = F.coalesce(F.col(column).rlike(f"[^{INERT}]"), F.lit(False))

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(column)
            kind = b.schema.field(at).type
            form = pa.array([unicodedata.normalize("NFKC", t) for t in b.column(at).to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([form if i == at else c for i, c in enumerate(b.columns)], schema=b.schema)

    return df.where(~may_change).unionByName(df.where(may_change).mapInArrow(run, df.schema))


def leaks(text: Column, form: Column | None = None) -> Column:
    """Whether a text names what no argument may name: a forbidden token of its compatibility form, or a path as it is.

    Without that form full-width letters alone count as their plain ones.
    """
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    form = F.translate(text, wide, "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))) if form is None else form
    f = F.regexp_replace(F.lower(form), r"(?U)[_\-./\\\s]+", "")
    hit = F.lit(False)
    for token in FORBIDDEN:
        hit = hit | F.contains(f, F.lit(token))
    for path in FORBIDDEN_PATHS:
        hit = hit | text.rlike(path)
    return hit


def leakage(df: DataFrame, text: str) -> DataFrame:
    """df with leaks, over whole texts; a null text leaks nothing."""
    form = f"_{text}_form"
    found = nfkc(df.withColumn(form, F.col(text)), form)
    return found.withColumn("leaks", F.coalesce(leaks(F.col(text), F.col(form)), F.lit(False))).drop(form)


def violations(**checks: Column) -> Column:
    """Names of the checks that a row fails, in order, joined by commas."""
    return F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in checks.items()])


def field_paths(schema, prefix: str = "") -> list[str]:
    """Dotted names of all fields of a schema, through structs, arrays and maps."""
    from pyspark.sql import types as S

    if isinstance(schema, S.StructType):
        return [p for f in schema for p in [f"{prefix}{f.name}", *field_paths(f.dataType, f"{prefix}{f.name}.")]]
    if isinstance(schema, S.ArrayType):
        return field_paths(schema.elementType, prefix)
    return field_paths(schema.valueType, prefix) if isinstance(schema, S.MapType) else []


def forbidden_fields(df: DataFrame, forbidden: list[str] = BLINDED) -> list[str]:
    """Paths of df's schema whose last name is forbidden: the schema is walked, no data."""
    return [p for p in field_paths(df.schema) if p.rsplit(".", 1)[-1].lower() in forbidden]


class HoldoutPolicy:
    """Which splits may be read, and a record of who asked."""

    def __init__(self, allowed: list[str]):
        self.allowed = sorted(set(allowed))

    def read(self, df: DataFrame, split: str = "split") -> DataFrame:
        """Rows of allowed splits only."""
        return df.where(F.col(split).isin(self.allowed))

    def log(self, df: DataFrame, purpose: str, split: str = "split") -> DataFrame:
        """One row for each split: what was asked for, how many rows, and whether they were handed out."""
        return df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("n")).select("split", "n", F.lit(purpose).alias("purpose"), F.col("split").isin(self.allowed).alias("granted"))
