"""Published builds, in two phases: tables first, then one row that names them.

    <folder>/builds/build=<id>/attempt=<n>/<table>     written once, never changed
    <folder>/pointers/                                 one JSON row a publication

A build writes all its tables into a folder of its own.  Only when every one of
them is complete is a row appended to the pointer log; the file that holds it
appears by one rename.  Readers resolve the newest row first, so they see the
old build whole or the new build whole, and a build that fails between two
tables is never seen.  Publishing a build again adds an attempt and a row.

What a manifest says about the tables is observed while they are written
(``DataFrame.observe``): no table is read again for it.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.tables import NothingToPublish, exists

POINTER = "ordinal long, build_id string, generated_at string, path string, format string, manifest string"


@dataclass(frozen=True)
class Publication:
    """One row of the pointer log."""

    ordinal: int
    build_id: str
    generated_at: str
    path: str
    format: str
    manifest: dict = field(default_factory=dict)


def _log(spark: SparkSession, folder: str) -> DataFrame | None:
    pointers = posixpath.join(folder, "pointers")
    return spark.read.schema(POINTER).json(pointers) if exists(spark, pointers) else None


def _newest(log: DataFrame | None) -> Publication | None:
    """The row of greatest ordinal; of two that ran at once, the later by time, then path."""
    if log is None:
        return None
    row = log.filter("path IS NOT NULL").agg(F.max_by(F.struct(*log.columns), F.struct("ordinal", "generated_at", "path")).alias("r")).first().r
    return row and Publication(row.ordinal, row.build_id, row.generated_at, row.path, row.format, json.loads(row.manifest or "{}"))


def current(spark: SparkSession, folder: str, build_id: str | None = None) -> Publication | None:
    """The newest publication, or the newest of ``build_id``; None before the first."""
    log = _log(spark, folder)
    return _newest(log if log is None or build_id is None else log.filter(F.col("build_id") == build_id))


def before(spark: SparkSession, folder: str, build_id: str) -> Publication | None:
    """The newest publication of another build that came before ``build_id`` was
    first published: the same one however often that build is published again."""
    log = _log(spark, folder)
    if log is None:
        return None
    first = log.filter(F.col("build_id") == build_id).agg(F.min("ordinal")).first()[0]
    others = log.filter(F.col("build_id") != build_id)
    return _newest(others if first is None else others.filter(F.col("ordinal") < first))


def read_table(spark: SparkSession, folder: str, name: str, build_id: str | None = None) -> DataFrame:
    """A table of the newest publication (of ``build_id``).  The pointer is
    resolved here, once: what is returned stays with that attempt."""
    found = current(spark, folder, build_id)
    if found is None:
        raise LookupError(f"nothing is published under {folder}" + (f" as build {build_id}" if build_id else ""))
    return table_of(spark, found, name)


def table_of(spark: SparkSession, publication: Publication, name: str) -> DataFrame:
    return spark.read.format(publication.format).load(posixpath.join(publication.path, name))


def observed(df: DataFrame, *measures: Column) -> tuple[DataFrame, Observation]:
    """``df`` that counts its rows, and more, when it is next written."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures), seen


def write_attempt(
    tables: dict[str, DataFrame], folder: str, build_id: str, fmt: str = "parquet", measures: dict[str, list[Column]] | None = None,
) -> tuple[str, dict[str, dict]]:
    """Phase one: all tables under a fresh folder, and what was seen of each
    (``rows`` and its ``measures``).  ``positions`` comes first: without any,
    ``NothingToPublish`` is raised and nothing else is written."""
    path = posixpath.join(folder, "builds", f"build={build_id}", f"attempt={uuid.uuid4().hex}")
    seen: dict[str, dict] = {}
    for name in sorted(tables, key=lambda n: n != "positions"):
        df, watch = observed(tables[name], *(measures or {}).get(name, ()))
        df.write.format(fmt).save(posixpath.join(path, name))
        # A plan that is known to be empty runs no task and reports nothing.
        seen[name] = {"rows": 0, **watch.get}
        if name == "positions" and not seen[name]["rows"]:
            raise NothingToPublish("no classified positions; the published build stays as it was")
    return path, seen


def point(spark: SparkSession, folder: str, build_id: str, generated_at: str, path: str, manifest: dict, fmt: str = "parquet") -> Publication:
    """Phase two: name the attempt.  One small file, renamed into place."""
    last = current(spark, folder)
    made = Publication((last.ordinal if last else 0) + 1, build_id, generated_at, path, fmt, manifest)
    row = [(made.ordinal, made.build_id, made.generated_at, made.path, made.format, json.dumps(manifest, sort_keys=True))]
    spark.createDataFrame(row, POINTER).coalesce(1).write.mode("append").json(posixpath.join(folder, "pointers"))
    return made


def publish(
    tables: dict[str, DataFrame], folder: str, build_id: str, generated_at: str, manifest=None, fmt: str = "parquet",
    measures: dict[str, list[Column]] | None = None,
) -> Publication:
    """Both phases.  ``manifest(seen)`` makes the manifest from what was seen."""
    spark = tables["positions"].sparkSession
    path, seen = write_attempt(tables, folder, build_id, fmt, measures)
    return point(spark, folder, build_id, generated_at, path, manifest(seen) if manifest else {"tables": seen}, fmt)
