"""Combinatorial fusion: every subset of >= 2 models, by weighted score
(SC) and weighted rank (RC), under every weighting scheme.

The subsets are driver-side metadata (2^M - M - 1 of them); ``lattice`` evaluates
them inside the tasks that hold the item rows.
"""

from __future__ import annotations

from itertools import combinations as _combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmix.functions import json_literal
from rankmix.model import FusedSpec, ScoreSet
from rankmix.operators.lattice import RC, SC, Layer, matrices
from rankmix.operators.weights import Weights

__all__ = ["RC", "SC", "subsets", "fused_specs", "layer_of", "layout_frame", "fused_matrices"]


def subsets(n: int, full_set_only: bool = False, max_size: int | None = None) -> list[tuple]:
    """Subsets of range(n) with >= 2 members, by size then lexicographic:
    2^n - n - 1 of them; ``max_size`` bounds the size."""
    sizes = [n] if full_set_only else range(2, min(max_size or n, n) + 1)
    return [c for k in sizes for c in _combinations(range(n), k)]


def fused_specs(models, schemes, include_base: bool = True, full_set_only: bool = False,
                max_size: int | None = None) -> list[FusedSpec]:
    """Output models in layer order: base models, then per scheme the subsets."""
    specs = []
    if include_base:
        specs += [FusedSpec(m, (i,), None) for i, m in enumerate(models)]
    combos = subsets(len(models), full_set_only, max_size) if schemes else []
    for s in schemes:
        for c in combos:
            specs.append(FusedSpec("".join(models[i] for i in c) + "_" + s, c, s))
    return specs


def _meta_array(values, dtype: str) -> Column:
    return json_literal(list(values), f"array<{dtype}>")


def layer_of(ss: ScoreSet, weights: Weights | None, specs: list[FusedSpec], kinds=(SC, RC)) -> Layer:
    """The layer whose outputs are ``specs``, of each kind in turn."""
    return Layer(ss, weights, [(kind, spec) for kind in kinds for spec in specs])


def layout_frame(spark, layout) -> DataFrame:
    """Metadata table ``(j, kind, fusion_model, scheme, size, output)`` of a
    layout; ``output`` numbers the pairs (members, scheme), so it tells outputs
    of one display name apart and is the same for SC and RC."""
    number: dict = {}
    data = [(j, kind, spec.name, spec.scheme, spec.size, number.setdefault((spec.members, spec.scheme), len(number)))
            for j, (kind, spec) in enumerate(layout)]
    return spark.createDataFrame(
        data, "j int, kind string, fusion_model string, scheme string, size int, output int")


def fused_matrices(ss: ScoreSet, weights: Weights | None, specs: list[FusedSpec],
                   kinds=(SC, RC), normalize: bool = True) -> DataFrame:
    """Long matrices ``(item_id, batch_id, j, kind, fusion_model, values)``; ``j``
    is the output's place in the layout (names need not be unique).

    SC values (base models included) are min-max scaled over the whole batch
    of that output model; RC values are weighted mean ranks, unscaled.  Scaled
    outputs are made a batch at a time (rows are clustered by ``batch_id``: no
    exchange), unscaled ones in blocks of any rows.
    """
    layer = layer_of(ss, weights, specs, kinds)
    names = _meta_array([spec.name for _, spec in layer.layout], "string")
    kinds_a = _meta_array([kind for kind, _ in layer.layout], "string")
    return matrices(layer, normalize).select(
        "item_id", "batch_id", "j", kinds_a[F.col("j")].alias("kind"), names[F.col("j")].alias("fusion_model"), "values")
