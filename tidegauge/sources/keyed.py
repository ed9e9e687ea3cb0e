"""Tables of rows that have a key and are revised: append versions, read the newest, fold old versions together.

A table is a folder partitioned by day and version.  A writer replaces its own
version only, so writing again leaves the same table; readers take the newest
version of each key in the days they ask for.  ``compact`` folds the versions of
days into one, which readers tell from its parts by its number.
"""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.ingest import exists

DAY, VERSION = "window_date", "version"


@dataclass(frozen=True)
class KeyedTable:
    """Rows keyed by ``key``, of which ``window_start`` is one column; ``version`` rises with each revision."""

    spark: SparkSession
    path: str
    key: tuple[str, ...]

    def all(self) -> DataFrame | None:
        """Every version of every row."""
        if not exists(self.spark, self.path):
            return None
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # no row was ever put there
                return None
            raise

    def upsert(self, rows: DataFrame, version: int) -> None:
        """Put ``rows`` as ``version``; what an earlier try of that version left in the days it covers is replaced."""
        out = rows.withColumns({DAY: F.to_date("window_start"), VERSION: F.lit(version).cast("long")})
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, VERSION).parquet(self.path)

    def newest(self, days: list | None = None, upto: int | None = None) -> DataFrame | None:
        """The newest version of each row, of some days alone, or as the table stood after the version ``upto``."""
        rows = self.all()
        if rows is None:
            return None
        if days is not None:
            rows = rows.where(F.col(DAY).isin(days))
        if upto is not None:
            rows = rows.where(F.col(VERSION) <= upto)
        rest = [c for c in rows.columns if c not in self.key]
        return rows.groupBy(*self.key).agg(F.max_by(F.struct(*rest), F.col(VERSION)).alias("_n")).select(*self.key, "_n.*")

    def compact(self, days: list) -> int:
        """Leave the newest version of each row of ``days`` only; returns how many partitions went.

        The folded rows take the number of the newest version that a day has, and
        replace it; only then do the older partitions go.  A reader between the two
        steps finds the same newest rows.
        """
        rows = self.all()
        if rows is None:
            return 0
        parts = rows.where(F.col(DAY).isin(days)).select(DAY, VERSION).distinct().collect()  # partition names
        top: dict = {}
        for r in parts:
            top[r[DAY]] = max(top.get(r[DAY], r[VERSION]), r[VERSION])
        old = [r for r in parts if r[VERSION] < top[r[DAY]]]
        if not old:
            return 0
        last = F.create_map(*[x for d, v in top.items() for x in (F.lit(d), F.lit(v))])
        folded = self.newest(sorted({r[DAY] for r in old})).withColumn(VERSION, last[F.col(DAY)])
        # Read in full before its own partitions are replaced.
        draft = f"{self.path.rstrip('/')}-draft-{max(top.values())}"
        folded.write.mode("overwrite").parquet(draft)
        self.spark.read.parquet(draft).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY, VERSION).parquet(self.path)
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        files = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for r in old:
            files.delete(path(f"{self.path}/{DAY}={r[DAY]}/{VERSION}={r[VERSION]}"), True)
        files.delete(path(draft), True)
        return len(old)


def claim(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the caller is the first to create the file ``name`` in ``folder``; the file system decides between racing callers."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path.getParent())
    if files.getUri().getScheme() == "file":  # whose streams are opened by a look first, then a creation
        return jvm.java.io.File(path.toUri().getPath()).createNewFile()
    try:
        files.create(path, False).close()
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    return True
