"""Random samples of equi-joins, as Spark DataFrame operations."""

from .operators.draws import expand_copies, poisson_cdf, poisson_draws
from .operators.frequencies import (
    key_frequencies,
    merge_key_frequencies,
    shared_key_counts,
    site_key_frequencies,
)
from .operators.unions import union_sites
from .operators.weights import attach_weights
from .plans.chains import Branch, join_sample_chain, join_sample_star
from .plans.sampling import Settings, federated_join_sample, join_sample, site_samples

__all__ = [
    "Branch",
    "Settings",
    "attach_weights",
    "expand_copies",
    "federated_join_sample",
    "join_sample",
    "join_sample_chain",
    "join_sample_star",
    "key_frequencies",
    "merge_key_frequencies",
    "poisson_cdf",
    "poisson_draws",
    "shared_key_counts",
    "site_key_frequencies",
    "site_samples",
    "union_sites",
]
