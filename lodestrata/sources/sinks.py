"""Writers: dataset packages, public projections, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Tables and columns that may leave the private store. Fixed values.
PUBLIC = {
    "claims": ("claim_id", "claim_type", "source_doi", "confidence", "verbatim_quote", "view_paths"),
    "sources": ("doi", "title", "authors", "year", "venue", "citation_count"),
    "nodes": ("view_id", "path", "name", "level", "claim_count"),
}


def package(tables: dict[str, DataFrame], folder: str, by: dict[str, str] | None = None) -> None:
    """Each table as JSON lines in folder/<name>, partitioned where `by` names a column."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if by and name in by:
            writer = writer.partitionBy(by[name])
        writer.json(f"{folder}/{name}")


def public(tables: dict[str, DataFrame], allowed: dict[str, tuple[str, ...]] = PUBLIC) -> dict[str, DataFrame]:
    """Allowed tables with their allowed columns; whatever isn't listed stays private."""
    return {name: df.select(*[c for c in allowed[name] if c in df.columns]) for name, df in tables.items() if name in allowed}


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine with its issues)."""
    return validated.filter("valid").drop("issues", "valid"), validated.filter("NOT valid")


def publish(df: DataFrame, folder: str, version: str, view: str) -> DataFrame:
    """Writes a new version beside the others and then switches the view to it."""
    path = f"{folder}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    out = df.sparkSession.read.parquet(path)
    out.createOrReplaceTempView(view)
    return out
