"""Rows to many rows, and rows mapped in parallel but returned in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from plumbline.operators.reshape import with_row_index
from plumbline.sources.pages import read_page

#: What a page can be taken apart into.
PARTS = {
    "rows": StructType().add("position", "integer").add("cells", ArrayType(StringType())),
    "cards": StructType().add("position", "integer").add("term", "string").add("value", "string"),
    "links": StructType().add("position", "integer").add("href", "string").add("label", "string"),
}


@udtf
class PageParts:
    """page_parts(html, part): the four-column table rows, cards or links of a page.

    The constant ``part`` decides the columns when the query is analysed.  A page without such parts, or a NULL one, has no rows."""

    @staticmethod
    def analyze(html: AnalyzeArgument, part: AnalyzeArgument) -> AnalyzeResult:
        if not part.isConstantExpression or part.value not in PARTS:
            raise ValueError(f"part is one of {sorted(PARTS)}")
        return AnalyzeResult(PARTS[part.value])

    def eval(self, html: str, part: str) -> Iterator[tuple]:
        if html is None:
            return
        page = read_page(html)
        found = {"rows": lambda: [(cells,) for cells in page.rows], "cards": lambda: list(page.cards.items()), "links": lambda: page.links}[part]()
        for k, values in enumerate(found):
            yield (k, *values)


def page_parts(pages: DataFrame, html: str, part: str, keep: Sequence[str]) -> DataFrame:
    """The columns ``keep`` of every page beside each of its parts."""
    return pages.lateralJoin(PageParts(F.col(html).outer(), F.lit(part))).select(*keep, *PARTS[part].names)


def parallel_map(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, order: Sequence[Column | str], ordinal: str = "ordinal") -> DataFrame:
    """``run`` over batches of rows on all executors; its rows come back in the order of the input, with their ``ordinal``.

    ``run`` gives one row for each row that it gets.  The ordinal travels beside it, so batches may end in any order."""
    numbered = with_row_index(df, order, ordinal)

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = run(part.drop(columns=ordinal))
            if len(out) != len(part):
                raise ValueError(f"{len(part)} rows went in and {len(out)} came out")
            yield out.assign(**{ordinal: part[ordinal].to_numpy()})

    return numbered.mapInPandas(each, f"{schema}, {ordinal} long").orderBy(ordinal)
