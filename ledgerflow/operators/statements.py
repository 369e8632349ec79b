"""SQL with parameter markers: values reach the statement as typed literals, never as text.

``statement`` runs a text with named markers (``:since``) over the session's
views and refuses names that the text and the values do not share, as a
mistyped marker would otherwise go unnoticed. ``batch_statement`` is the
incremental batch as such a text; table, columns and values are all bound by
the session, so a hostile name or value stays a name or a value, and the bound
still reaches the scan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# What a marker is not looked for in: quoted texts and names, comments, and casts (two colons).
_SKIPPED = r"'(?:[^'\\\\]|\\\\.|'')*'|\"(?:[^\"\\\\]|\\\\.)*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|::"
_MARKER = re.compile(rf"{_SKIPPED}|:([A-Za-z_]\w*)", re.DOTALL)


class MarkerMismatch(ValueError):
    """A marker without a value, or a value without a marker."""


def markers(text: str) -> set[str]:
    """The names of the markers in a statement."""
    return {m.group(1) for m in _MARKER.finditer(text) if m.group(1)}


def statement(spark: SparkSession, text: str, values: Mapping[str, object]) -> DataFrame:
    """Run ``text`` with its markers bound to ``values``."""
    named = markers(text)
    if named != set(values):
        without, unused = sorted(named - set(values)), sorted(set(values) - named)
        raise MarkerMismatch(f"markers without a value: {without}; values without a marker: {unused}")
    return spark.sql(text, args=dict(values))


def batch_statement(
    spark: SparkSession, view: str, columns: Sequence[str], key: str, since: object, limit: int
) -> DataFrame:
    """The ``limit`` rows of ``view`` that follow ``since`` by ``key``, in key order."""
    listed = ", ".join("IDENTIFIER(:column_%d)" % i for i in range(len(columns)))
    text = f"SELECT {listed} FROM IDENTIFIER(:view) WHERE IDENTIFIER(:key) > :since ORDER BY IDENTIFIER(:key) ASC LIMIT :most"
    names = {f"column_{i}": _quoted(c) for i, c in enumerate(columns)}
    return statement(spark, text, {**names, "view": view, "key": _quoted(key), "since": since, "most": limit})


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
