"""What the corpus operators share: words, and the engine's storage, numbering and components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import broadcast_if_small, global_row_number, materialize, read_table, partitions_for, shared_dir, shuffle_partitions, tidy

__all__ = ["WORD", "broadcast_if_small", "components", "global_row_number", "let", "materialize", "partitions_for", "read_table", "shared_dir", "shuffle_partitions", "text_or_empty", "tidy"]

#: A word of every contract: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
