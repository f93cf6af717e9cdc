"""Table functions of the user: their columns follow the table they are given, and rows come a partition at a time, in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@F.udtf
class Runs:
    """Runs(TABLE(t) PARTITION BY key ORDER BY ..., 'key', 'value', 'id'): rows next to each other with one value of a key.

    key and value (of the table's types), first and last (the ids at the run's ends) and n. Rows stream by and one run is held,
    however long the partition. A null value is a value, equal to other nulls; a null key is a partition; an empty table gives no rows.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, key: AnalyzeArgument, value: AnalyzeArgument, id: AnalyzeArgument) -> AnalyzeResult:  # noqa: A002
        for name in (key, value, id):
            if not name.isConstantExpression or name.value not in table.dataType.names:
                raise ValueError(f"the names of columns are constants that the table has, not {name.value!r}")
        of = {x: table.dataType[x.value].dataType for x in (key, value, id)}
        return AnalyzeResult(T.StructType([T.StructField(key.value, of[key]), T.StructField(value.value, of[value]), T.StructField("first", of[id]), T.StructField("last", of[id]), T.StructField("n", T.LongType())]))

    def __init__(self) -> None:
        self.run: tuple | None = None

    def eval(self, row: Row, key: str, value: str, id: str) -> Iterator[tuple]:  # noqa: A002
        if self.run is not None and self.run[1] == row[value]:
            self.run = (*self.run[:3], row[id], self.run[4] + 1)
            return
        if self.run is not None:
            yield self.run
        self.run = (row[key], row[value], row[id], row[id], 1)

    def terminate(self) -> Iterator[tuple]:
        if self.run is not None:
            yield self.run
