"""Writers: strict-JSON rows, routes and meta.

B1 (see operators.ledger.append_ledger), B2 write_rows, B3 write_routes,
B4 write_meta; B5/B6/B7 documents go through ``sinks.containers``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagefleet.functions import scalar
from pagefleet.sinks.containers import write_documents


def write_rows(df: DataFrame, path: str, limit: int | None = None, order_by: list[str] | None = None) -> None:
    """B2: strict-JSON row payload (I11 coercions, nulls kept, no NaN tokens)."""
    if limit is not None:
        df = (df.orderBy(*order_by) if order_by else df).limit(max(limit, 0))
    df.select(scalar.json_text(df).alias("value")).write.mode("overwrite").text(path)


def write_routes(routes: DataFrame, path: str, membership: DataFrame | None = None) -> None:
    """Nested route payload as JSON plus the flat route membership as Parquet.

    The nested form never embeds an unbounded row list; the rows of a route
    are the flat ``route_rows`` table.
    """
    routes.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/routes")
    if membership is not None:
        membership.write.mode("overwrite").parquet(f"{path}/route_rows")


def write_meta(meta: DataFrame, path: str, site: str = "site") -> None:
    """One strict-JSON meta document per site, in containers keyed by site."""
    write_documents(meta.select(site, scalar.strict_json(F.col("meta")).alias("line")), path, [site], [])
