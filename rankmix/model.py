"""Data model shared by all operators.

A *score set* is one row per item holding every model's class scores side by
side: ``item_id``, optional ``label``/``batch_id``, and one ``ARRAY<DOUBLE>``
column per model (``s0``, ``s1`` ...; array position = class) plus, once
ranked, ``r0``, ``r1`` ... .  Model names live in the driver-side metadata
(``models``), never in column names, so any name works and the generated
expressions stay short.

Long form ``(item_id, model, cls, score)`` is the interchange format for
files and reports; ``to_wide`` / ``to_long`` convert.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def s_col(i: int) -> str:
    return f"s{i}"


def r_col(i: int) -> str:
    return f"r{i}"


@dataclass(frozen=True)
class ScoreSet:
    df: DataFrame
    models: tuple[str, ...]
    n_classes: int
    has_label: bool = True
    has_ranks: bool = False
    batch_size: int | None = None
    # accuracy (percent) of each model, when known; used by the WCP scheme
    accuracies: tuple[float, ...] | None = field(default=None)
    # the table that holds the rows, when ``materialize`` wrote one
    table: str | None = None
    # the item ids alone, where they can be had without making the scores
    ids: DataFrame | None = None
    # layers raise on an item without some class's score unless this is set
    allow_missing: bool = False

    @property
    def n_models(self) -> int:
        return len(self.models)

    def scores(self, i: int) -> Column:
        return F.col(s_col(i))

    def ranks(self, i: int) -> Column:
        return F.col(r_col(i))

    def with_df(self, df: DataFrame, **kw) -> "ScoreSet":
        return replace(self, df=df, **kw)

    def key_cols(self) -> list[str]:
        cols = ["item_id"]
        if self.batch_size is not None:
            cols.append("batch_id")
        if self.has_label:
            cols.append("label")
        return cols


@dataclass(frozen=True)
class FusedSpec:
    """One output model of a fusion layer.

    ``members`` index into ``ScoreSet.models``; ``scheme`` is ``None`` for a
    base model.  ``name`` is for display only (see ``members`` for identity).
    """

    name: str
    members: tuple[int, ...]
    scheme: str | None

    @property
    def is_base(self) -> bool:
        return self.scheme is None

    @property
    def size(self) -> int:
        return len(self.members)
