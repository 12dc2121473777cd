"""Column expressions (JVM-side) used by the operators."""

from rankmix.functions.arrays import (TOL, array_pick, avg_rank_desc, cd_of, has_ties, json_literal,
                                      ksi_of, let, lsum, minmax_row, order_of, ordinal_rank_desc,
                                      pick, rsc_desc)

__all__ = ["TOL", "array_pick", "avg_rank_desc", "cd_of", "has_ties", "json_literal", "ksi_of",
           "let", "lsum", "minmax_row", "order_of", "ordinal_rank_desc", "pick", "rsc_desc"]
