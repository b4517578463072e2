"""What a query hands back: column names, typed rows, and the text form that clients of the wire protocol read."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, Row


#: Rows that one answer on the wire may have; it is built whole in the driver's memory.
MAX_WIRE_ROWS = 1_000_000


@dataclass
class QueryResult:
    """A result whose rows are fetched when asked for, a partition at a time."""

    frame: DataFrame

    @property
    def columns(self) -> list[str]:
        return self.frame.columns

    def rows(self) -> Iterator[Row]:
        return self.frame.toLocalIterator(prefetchPartitions=True)

    def records(self) -> Iterator[str]:
        """Rows as JSON texts, nulls kept: what a queue sink receives."""
        for row in self.rows():
            yield json.dumps(row.asDict(recursive=True), default=str)

    def as_wire(self, max_rows: int = MAX_WIRE_ROWS) -> dict[str, object]:
        """{"size", "0" .. "n-1": list of texts, "meta": names}. More than max_rows rows are an error, not a part of the answer."""
        rows = [["" if v is None else str(v) for v in row] for row in islice(self.rows(), max_rows + 1)]
        if len(rows) > max_rows:
            raise ValueError(f"the answer has more than {max_rows} rows; narrow the statement, page it with LIMIT and OFFSET, or store it")
        return {"size": len(rows), **{str(i): r for i, r in enumerate(rows)}, "meta": self.columns}
