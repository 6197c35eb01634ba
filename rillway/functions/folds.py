"""Ordered folds of arrays that gather a growing list, in time near linear."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK = 64


def gathering_fold(log: Column, start: dict[str, Column], grows: str, kind: str, step: Callable[[Column, Column], Column]) -> Column:
    """``aggregate(log, start, step)`` for a step that appends to the array ``grows`` (elements of ``kind``).

    Appending to one array copies it each time. Here chunks of CHUNK entries are folded by themselves, each
    into a list of its own, and the lists are joined once at the end. ``step`` takes and gives a struct of
    the fields of ``start`` and then ``grows``. An empty log gives the start.
    """
    fields = list(start)
    empty = F.expr(f"cast(array() as array<{kind}>)")
    chunks = F.transform(F.filter(F.sequence(F.lit(0), F.size(log)), lambda i: (i % CHUNK == 0) & (i < F.size(log))), lambda i: F.slice(log, i + 1, F.lit(CHUNK)))
    outer = F.struct(*(start[f].alias(f) for f in fields), F.expr(f"cast(array() as array<array<{kind}>>)").alias(grows))

    def chunk_step(a: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(*(a[f].alias(f) for f in fields), empty.alias(grows)), step)
        # a fold over one element binds the inner result to a name, so that it is evaluated once
        return F.aggregate(F.array(inner), a, lambda b, x: F.struct(*(x[f].alias(f) for f in fields), F.concat(b[grows], F.array(x[grows])).alias(grows)))

    return F.aggregate(chunks, outer, chunk_step, lambda a: F.struct(*(a[f].alias(f) for f in fields), F.flatten(a[grows]).alias(grows)))
