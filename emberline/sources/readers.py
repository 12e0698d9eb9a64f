"""Readers with declared schemas, record rules and error gates."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline import schemas
from emberline.functions import rules
from emberline.functions.times import When
from emberline.operators import quality
from emberline.sources import json_arrays

CORRUPT = "_corrupt_record"
MAX_BAD_PROFILES = 0.10
MAX_BAD_EVENTS = 0.05


class LoadError(ValueError):
    """Too many bad records, or a critical quality issue."""


@dataclass(frozen=True)
class Loaded:
    """Clean rows, rows to quarantine (with reasons) and the share of the latter."""

    clean: DataFrame
    quarantine: DataFrame
    bad_share: float


def _read_json(spark: SparkSession, path: str, schema: T.StructType, array_file: bool) -> DataFrame:
    """One row per record, parsed whole from its text, so that what counts as corrupt does not depend
    on the columns somebody reads later.

    Instants are read as text and cast afterwards, so a bad one becomes null instead of failing.
    """
    instants = {f.name: f.dataType for f in schema if isinstance(f.dataType, (T.TimestampNTZType, T.DateType))}
    fields = [T.StructField(f.name, T.StringType() if f.name in instants else f.dataType) for f in schema]
    if array_file:
        records = json_arrays.read_records(spark, path)
    else:
        records = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("record"), F.lit(False).alias("broken"))
    parsed = F.from_json(
        "record", T.StructType([*fields, T.StructField(CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    raw = records.select("record", "broken", parsed.alias("parsed")).select(
        *[F.col("parsed")[f.name].alias(f.name) for f in fields],
        F.coalesce(F.col("parsed")[CORRUPT], F.when(F.col("parsed").isNull() | F.col("broken"), F.coalesce("record", F.lit("")))).alias(CORRUPT),
    )
    return raw.withColumns({n: F.col(n).try_cast(t) for n, t in instants.items()})


#: Partition of a landing folder that tells the stored bad records from the good ones.
QUARANTINED = "quarantined"


def _landed(spark: SparkSession, landing: str, schema: T.StructType) -> DataFrame:
    stored = T.StructType([*schema, T.StructField(QUARANTINED, T.BooleanType())])
    return spark.read.schema(stored).parquet(landing)


def read_quarantine(spark: SparkSession, landing: str) -> DataFrame:
    """The bad records of a load, with their reasons, as its landing folder keeps them."""
    return spark.read.parquet(landing).where(F.col(QUARANTINED).cast("string") == "true").drop(QUARANTINED)


def _gated(
    df: DataFrame, rule_set: Mapping[str, Column], limit: float, what: str, landing: str | None
) -> Loaded:
    """Check every record and stop when too many are bad.

    With a ``landing`` folder the text is parsed once: clean and bad rows are written there, in partitions
    of their own, and counted from the files' footers; all later work reads the columns it needs.
    Without one the text is parsed again by every use, with the same outcome.
    """
    # not counted with observe(): once a session has used that, it cannot serialise MLlib models that hold a summary
    checked = rules.with_reasons(df, {"corrupt_record": F.col(CORRUPT).isNotNull(), **rule_set})
    bad = F.size("reasons") > 0
    if landing is None:
        counts = {r[0]: r[1] for r in checked.groupBy(bad).count().collect()}
        clean, quarantine = rules.split(checked)
    else:
        checked.withColumn(QUARANTINED, bad).write.mode("overwrite").partitionBy(QUARANTINED).parquet(landing)
        stored = _landed(df.sparkSession, landing, checked.schema)
        counts = {r[0]: r[1] for r in stored.groupBy(QUARANTINED).count().collect()}
        clean = stored.where(~F.col(QUARANTINED)).drop(QUARANTINED, "reasons")
        quarantine = stored.where(F.col(QUARANTINED)).drop(QUARANTINED)
    total = sum(counts.values())
    share = counts.get(True, 0) / total if total else 0.0
    if share > limit:
        first = quarantine.groupBy(F.get("reasons", 0)).count().collect()  # at most one row per rule
        raise LoadError(f"{share:.1%} of the {what} records are bad, over {limit:.0%}: {sorted(r[0] for r in first)[:5]}")
    return Loaded(clean.drop(CORRUPT), quarantine, share)


def load_profiles(
    spark: SparkSession, path: str, array_file: bool = False, landing: str | None = None
) -> Loaded:
    """Profiles from JSON; aborts when more than 10 % of them are bad.

    The default is JSON Lines; ``array_file`` reads files that hold one JSON array each. Both split across tasks.
    """
    raw = _read_json(spark, path, T.StructType([*schemas.PROFILES, *schemas.PROFILE_EXTRAS]), array_file)
    return _gated(raw, rules.profile_rules(), MAX_BAD_PROFILES, "profile", landing)


def load_events(
    spark: SparkSession, path: str, as_of: When, array_file: bool = False, landing: str | None = None
) -> Loaded:
    """Events from JSON; aborts above 5 % bad rows or on a failed critical quality check."""
    raw = _read_json(spark, path, schemas.EVENTS, array_file)
    loaded = _gated(raw, rules.event_rules(), MAX_BAD_EVENTS, "event", landing)
    failed = (
        quality.critical_event_checks(loaded.clean, as_of)
        .where(~F.col("passed") & (F.col("severity") == "critical"))
        .select("message")
        .collect()  # at most one row per critical rule
    )
    if failed:
        raise LoadError(f"failed critical checks of the events: {[r.message for r in failed]}")
    return loaded


def load_churn_features(
    spark: SparkSession, path: str, array_file: bool = False, landing: str | None = None
) -> DataFrame:
    """Churn features from JSON; a single bad row aborts."""
    raw = _read_json(spark, path, schemas.CHURN_FEATURES, array_file)
    return _gated(raw, rules.churn_feature_rules(), 0.0, "churn feature", landing).clean


def load_all(
    spark: SparkSession, folder: str, as_of: When, array_file: bool = False, landing: str | None = None
) -> dict[str, DataFrame]:
    """The three input files of a data folder."""

    def source(name: str) -> dict:
        target = f"{landing.rstrip('/')}/{name}" if landing else None
        return {"path": f"{folder}/{name}.json", "array_file": array_file, "landing": target}

    return {
        "player_profiles": load_profiles(spark, **source("player_profiles")).clean,
        "player_events": load_events(spark, as_of=as_of, **source("player_events")).clean,
        "churn_features": load_churn_features(spark, **source("churn_features")),
    }


def _csv_cells(spark: SparkSession, path: str, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """file, line and cells of each line below a header, and the header of each file: where the ``wanted`` columns stand.

    The header of a file is its line that holds all of their names; a record is one line.
    """
    text = spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.rtrim("value", F.lit("\r")).alias("line"))
    named = text.where(reduce(lambda a, b: a & b, [F.col("line").contains(n) for n in wanted]))
    widest = named.agg(F.max(F.size(F.split("line", ",")))).first()[0]
    if widest is None:
        raise LoadError(f"no behaviour file has the columns {wanted}")
    parsed = F.from_csv("line", ", ".join(f"c{i} string" for i in range(widest)))
    cells = F.array(*[parsed[f"c{i}"] for i in range(widest)])
    heads = named.select("file", "line", F.transform(cells, F.trim).alias("names"))
    heads = heads.where(F.size(F.array_intersect("names", F.array(*[F.lit(n) for n in wanted]))) == len(wanted))
    heads = heads.groupBy("file").agg(F.min("line").alias("head"), F.min("names").alias("names"))
    return text.select("file", "line", cells.alias("cells")), heads


def load_behavior_csv(spark: SparkSession, path: str) -> Loaded:
    """The columns used of the behaviour CSV; each file's own header tells where they stand, in any order.

    Rows of a file without such a header, and rows with a value that is not of its column's type, are quarantined
    with their reasons, their line and their file. A folder without any header is an error.
    """
    schema = schemas.BEHAVIOR_CSV
    rows, heads = _csv_cells(spark, path, schema.names)
    met = rows.join(heads, "file", "left").where("head is null or line <> head")
    picked = {f.name: F.get("cells", F.array_position("names", f.name).cast("int") - 1) for f in schema}
    typed = met.select("file", "line", "head", *[F.trim(c).alias(f"text_{n}") for n, c in picked.items()])
    typed = typed.select("file", "line", "head", *[f"text_{n}" for n in picked], *[F.col(f"text_{f.name}").try_cast(f.dataType).alias(f.name) for f in schema])
    wrong = {f"bad_{n}": F.col(n).isNull() & F.col(f"text_{n}").isNotNull() for n in picked}
    checked = rules.with_reasons(typed, {"file_without_header": F.col("head").isNull(), **wrong}).drop("head", *[f"text_{n}" for n in picked])
    clean, bad = rules.split(checked)
    total, failed = checked.agg(F.count("*"), F.count_if(F.size("reasons") > 0)).first()
    return Loaded(clean.select(*schema.names), bad, failed / total if total else 0.0)


def read_behavior_csv(spark: SparkSession, path: str) -> DataFrame:
    """The good rows of :func:`load_behavior_csv`."""
    return load_behavior_csv(spark, path).clean


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table; an empty one with the declared schema if nothing was written yet."""
    schema = schemas.TABLES[name]
    try:
        return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in names or schemas.TABLES}


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    lower: str,
    upper: str,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A table of a relational database, read in parallel slices of ``partition_column``."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=partition_column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=str(partitions),
            preferTimestampNTZ="true",
            **options,
        )
        .load()
    )


def run_sql(
    spark: SparkSession, query: str, params: dict | None = None, tables: Mapping[str, DataFrame] | None = None
) -> DataFrame:
    """SQL with ``:name`` parameters over the given tables, which the query names as ``{name}``.

    The session's own views are neither seen under these names nor changed.
    """
    return spark.sql(query, args=params or {}, **(tables or {}))


def sample_players(df: DataFrame, n: int, seed: int = 42, key: str = "player_id") -> DataFrame:
    """n rows without replacement: those with the smallest seeded hash of the key."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(order).limit(n)
