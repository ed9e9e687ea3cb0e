"""The bounded labelled sample that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: crc32 of the id's decimal digits modulo FOLDS; fold 0 is held out.
FOLDS = 5


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, label, text`` of at most ``bound`` rows outside the held-out fold.

    Ids are taken in the order of their hash, so the sample is uniform and the
    same on every run.  Rows without label, id or text are not used; ids that
    carry different labels are not used either.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).alias("label"), F.max(label).alias("_max"))
        .where("label = _max")
        .select("id", F.col("label").cast("int"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(bound)
    )
    # At most `bound` rows of two numbers: fit to be broadcast.
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids), "id").dropDuplicates(["id"])
