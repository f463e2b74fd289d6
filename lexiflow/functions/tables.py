"""Table functions for SQL text: registered once, joined laterally, with a schema that is planned from the arguments."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexiflow.functions import values as V

#: What an outline may list, and the columns of each.
PARTS = {
    "blocks": StructType().add("block_no", LongType()).add("tag", StringType()).add("n_chars", LongType()),
    "texts": StructType().add("text_no", LongType()).add("begin", LongType()).add("text", StringType()),
}


class PageOutline:
    """``page_outline(html, part)``: a page's block elements, or its text nodes, in document order; none of a null page.

    ``part`` must be a constant, for the columns follow from it.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument, part: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(html.dataType, StringType):
            raise ValueError("page_outline reads a string of HTML")
        if not part.isConstantExpression or part.value not in PARTS:
            raise ValueError(f"the second argument is one of {', '.join(PARTS)}")
        return AnalyzeResult(PARTS[part.value])

    def eval(self, html: str | None, part: str) -> Iterator[tuple]:
        from lexiflow.sources.html import _Tree

        if html is None:
            return
        tree = _Tree(html)
        if part == "texts":
            yield from ((i, t["begin"], t["text"]) for i, t in enumerate(tree.texts, 1))
        else:
            blocks = [n for n in tree.nodes if n["tag"] in V.BLOCK_TAGS]
            yield from ((i, n["tag"], n["size"]) for i, n in enumerate(blocks, 1))


def register(spark: SparkSession) -> None:
    """The functions under their names in SQL text."""
    spark.udtf.register("page_outline", udtf(PageOutline))
