"""The queries by name, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value: object) -> str:
    """A value as SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list | tuple):
        return "[" + ", ".join(map(literal, value)) + "]"
    return repr(value)


def case_query(name: str, inputs: str, outputs: dict[str, str], cases: Sequence[tuple], build: Callable[[DataFrame], dict[str, Column] | DataFrame]) -> None:
    """A query over all customers. Customer k takes case k modulo the number of cases; a # in a text is the last digit
    of k. A case is a tuple of input values (schema `inputs`), then the values that `outputs` (name: SQL type) must have,
    written out. `build` makes the outputs from a frame with c_custkey and the inputs: the SQL looks them up."""
    n, width = len(cases), len(inputs.split(", "))
    kinds = [c.split(" ", 1) for c in inputs.split(", ")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.createDataFrame([(i, *case[:width]) for i, case in enumerate(cases)], f"__case int, {inputs}")
        keys = table(spark, sf_dir, "customer").select("c_custkey")
        # the cases are a constant of this file
        joined = keys.join(F.broadcast(rows), F.col("c_custkey") % n == F.col("__case"))
        digit = (F.col("c_custkey") % 10).cast("string")
        filled = {c: F.replace(c, F.lit("#"), digit) if kind == "string" else F.col(c) for c, kind in kinds}
        df = joined.select("c_custkey", *(v.alias(c) for c, v in filled.items()))
        made = build(df)
        return made if isinstance(made, DataFrame) else df.select("c_custkey", *(v.alias(c) for c, v in made.items()))

    run.__name__ = name
    values = ", ".join(f"({i}, {', '.join(map(literal, case[width:]))})" for i, case in enumerate(cases))
    shown = ", ".join((f"replace(CAST({c} AS VARCHAR), '#', (c_custkey % 10)::VARCHAR) AS {c}" if kind == "VARCHAR" else f"CAST({c} AS {kind}) AS {c}") for c, kind in outputs.items())
    query(f"SELECT c_custkey, {shown} FROM customer JOIN (VALUES {values}) cases(i, {', '.join(outputs)}) ON c_custkey % {n} = i")(run)
