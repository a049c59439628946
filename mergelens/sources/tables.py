"""Table sources: scans, point lookups and the filters that reach the parquet reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergelens.errors import InvalidRequest


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Full scan of one table; columns and filters are pruned by the reader."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def find_by_id(df: DataFrame, key, column: str = "id") -> DataFrame:
    """Point lookup: at most one row; a null key finds nothing."""
    return df.where(F.col(column) == F.lit(key)).limit(1)


def find_by_full_name(df: DataFrame, name: str, column: str = "full_name") -> DataFrame:
    return df.where(F.col(column) == F.lit(name))


def find_by_active(df: DataFrame, active: bool = True) -> DataFrame:
    return df.where(F.col("is_active") == F.lit(active))


def find_by_request_key(df: DataFrame, full_name: str, number: int) -> DataFrame:
    """Compound lookup by repository and pull-request number."""
    return df.where((F.col("repository_full_name") == full_name) & (F.col("platform_pr_id") == number))


def find_by_status(df: DataFrame, status: str) -> DataFrame:
    return df.where(F.col("status") == F.lit(parse_status(status)))


def find_by_repository(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("repository_full_name") == F.lit(name))


#: The states of a request.
STATUSES = ("PENDING", "REVIEWING", "COMPLETED", "FAILED")


def parse_status(text: str) -> str:
    """Upper-cases a status literal; an unknown one raises."""
    status = text.upper()
    if status not in STATUSES:
        raise InvalidRequest(f"unknown status {text!r}; one of {', '.join(STATUSES)}")
    return status


def status_domain(column: Column) -> Column:
    """The status, or an error for a value outside the domain; null stays null."""
    return F.when(column.isNull() | column.isin(*STATUSES), column).otherwise(F.raise_error(F.concat(F.lit("unknown status "), column)))


def list_requests(df: DataFrame, repository: str | None = None, status: str | None = None, combine: bool = False) -> DataFrame:
    """Request list: the repository filter wins over the status filter and the two
    don't combine, unless ``combine`` asks for both (an extension)."""
    if repository is not None:
        df = find_by_repository(df, repository)
        return find_by_status(df, status) if combine and status is not None else df
    return find_by_status(df, status) if status is not None else df
