"""DataFrame operators: ranks, weights, fusion, evaluation, votes, preparation."""
