"""Session settings, checkpointing and small-table helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def build_session(app: str = "tidyward", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # call sites of every column make long rule chains slow to build
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Without it a local session gets a temporary folder, and a cluster raises: its machines would not
    see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not is_local(spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="tidyward-")
    return _LOCAL[app]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, ending its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as a table of columns and read it back.

    Ends the lineage as :func:`cut` does, but takes less room, and each reader reads only its columns. For
    tables that are read several times, by a part of their columns.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_local(master: str) -> bool:
    """One machine does all the work; ``local-cluster`` has executors of its own."""
    return master == "local" or master.startswith("local[")


BROADCAST_BYTES = 32 << 20


def fits(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a checkpointed table take at most ``max_bytes`` as text."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return size <= max_bytes


def broadcast_within(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a checkpointed table that fits.

    A larger one comes back without the hint and joins by shuffle, where adaptive
    execution splits skewed partitions; the result is the same.
    """
    return F.broadcast(df) if fits(df, max_bytes) else df


def pinned(df: DataFrame) -> DataFrame:
    """A join side computed once, broadcast if its measured size allows."""
    return broadcast_within(cut(df))


def join_known(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which rows with a null key, which match nothing, are spread out."""
    missing = F.lit(False)
    for k in keys:
        missing = missing | F.col(k).isNull()
    return (df.withColumn("__spread", F.when(missing, F.monotonically_increasing_id() + 1).otherwise(F.lit(0)))
            .join(other.withColumn("__spread", F.lit(0).cast("bigint")), [*keys, "__spread"], "left")
            .drop("__spread"))


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def rule_table(spark: SparkSession, columns: list[str], rows) -> DataFrame:
    """A fixed rule list as a table whose size the planner knows."""
    values = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(columns)})")
