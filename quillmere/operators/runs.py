"""Versions of the corpus: tables of a run, views that point at the active one, promotion with rollback."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[a-z0-9][a-z0-9_]{0,62}")


def shadow_name(name: str, run: str) -> str:
    if not NAME.fullmatch(run):
        raise ValueError(f"not a run id: {run!r}")
    return f"{name}__shadow__{run}"


def updated_status(manifest: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """A new version of the manifest in which the changes' non-null columns replace the old ones, by file_id."""
    c = changes.select("file_id", *[F.col(x).alias(f"__{x}") for x in columns])
    x = manifest.join(c, "file_id", "left")
    return x.select(*[F.coalesce(f"__{k}", k).alias(k) if k in columns else F.col(k) for k in manifest.columns])


def upserted(index: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """index without the keys of new, and new."""
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def active(spark: SparkSession, alias: str) -> str | None:
    """The table that an alias names now."""
    got = [r.value for r in spark.sql("SHOW TBLPROPERTIES quillmere_aliases").collect() if r.key == alias] if spark.catalog.tableExists("quillmere_aliases") else []
    return got[0] if got else None


def _point(spark: SparkSession, alias: str, table: str | None) -> None:
    spark.sql("CREATE TABLE IF NOT EXISTS quillmere_aliases (x INT) USING parquet")
    if table is None:
        spark.sql(f"DROP VIEW IF EXISTS {alias}")
        spark.sql(f"ALTER TABLE quillmere_aliases UNSET TBLPROPERTIES IF EXISTS ('{alias}')")
    else:
        spark.sql(f"CREATE OR REPLACE VIEW {alias} AS SELECT * FROM {table}")
        spark.sql(f"ALTER TABLE quillmere_aliases SET TBLPROPERTIES ('{alias}' = '{table}')")


def promote(spark: SparkSession, targets: dict[str, str], errors: DataFrame, counts: dict[str, int]) -> dict[str, str | None]:
    """Points every alias at its new table, all or none; returns what each pointed at before.

    Refused when a gate has errors or a table does not hold the expected number of rows; if one alias can't be moved, those
    moved before go back.
    """
    if bad := errors.limit(5).collect():
        raise ValueError(f"gates failed: {[tuple(r) for r in bad]}")
    for alias, table in targets.items():
        if alias in counts and (n := spark.table(table).count()) != counts[alias]:
            raise ValueError(f"{table} has {n} rows, not {counts[alias]}")
    before = {alias: active(spark, alias) for alias in targets}
    moved: list[str] = []
    try:
        for alias, table in targets.items():
            _point(spark, alias, table)
            moved.append(alias)
    except Exception:
        for alias in reversed(moved):
            _point(spark, alias, before[alias])
        raise
    return before
