"""rankmix — combinatorial score/rank fusion of model outputs on Apache Spark.

Items, models, classes and fused-model combinations are DataFrame rows and
columns; every operator returns a lazy DataFrame so Catalyst can prune,
push down and fuse the whole plan.
"""

from rankmix.model import ScoreSet, FusedSpec

__all__ = ["ScoreSet", "FusedSpec"]
