"""Double-difference earthquake relocation and posterior-sample analytics on Spark."""

import sys

from pyspark import cloudpickle

from tremorframe.functions.network import NetworkTravelTime, load_weights
from tremorframe.functions.travel_time import StraightRay
from tremorframe.operators.distributions import (
    cumulative_histogram,
    density_curve,
    histogram,
    histogram2d,
)
from tremorframe.operators.effective_size import effective_sample_size, ess_summary
from tremorframe.operators.forward import phase_mad, residuals
from tremorframe.operators.objective import event_gradient, posterior
from tremorframe.operators.observations import cut_long_edges, thin_exactly
from tremorframe.operators.posterior import (
    catalog_and_chains,
    centred_chains,
    pooled_catalog,
    posterior_catalog,
    posterior_means,
    std_uncertainty,
)
from tremorframe.params import RunParams
from tremorframe.plans.prepare import prepare_inputs, prepare_observations
from tremorframe.plans.relocate import relocate
from tremorframe.sources.sample_store import read_samples, save_samples

# Arrow functions travel with their code, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "NetworkTravelTime",
    "RunParams",
    "StraightRay",
    "catalog_and_chains",
    "centred_chains",
    "cumulative_histogram",
    "cut_long_edges",
    "density_curve",
    "effective_sample_size",
    "ess_summary",
    "event_gradient",
    "histogram",
    "histogram2d",
    "load_weights",
    "phase_mad",
    "pooled_catalog",
    "posterior",
    "posterior_catalog",
    "posterior_means",
    "prepare_inputs",
    "prepare_observations",
    "read_samples",
    "relocate",
    "residuals",
    "save_samples",
    "std_uncertainty",
    "thin_exactly",
]
