"""Which rows a query may return: predicates on paths and extensions."""

from __future__ import annotations

import operator
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scope:
    """Path prefixes (any), substrings (all), forbidden substrings (all) and extensions (any); literal and case-sensitive. Empty lists do not restrict."""

    path_prefix: tuple[str, ...] = field(default=())
    path_contains: tuple[str, ...] = field(default=())
    path_not_contains: tuple[str, ...] = field(default=())
    extension: tuple[str, ...] = field(default=())

    def predicate(self) -> Column | None:
        """The conjunction, which reaches the scan; None if nothing is restricted."""
        path, parts = F.col("file_path"), []
        if self.path_prefix:
            parts.append(reduce(operator.or_, (path.startswith(p) for p in self.path_prefix)))
        parts += [path.contains(p) for p in self.path_contains]
        parts += [~path.contains(p) for p in self.path_not_contains]
        if self.extension:
            parts.append(F.col("extension").isin(*self.extension))
        return reduce(operator.and_, parts) if parts else None

    def apply(self, rows: DataFrame) -> DataFrame:
        where = self.predicate()
        return rows if where is None else rows.where(where)

    def flag(self) -> Column:
        """The predicate as a column, true where nothing is restricted."""
        where = self.predicate()
        return F.lit(True) if where is None else F.coalesce(where, F.lit(False))
