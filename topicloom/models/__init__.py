"""Gibbs-sampled topic models as data-parallel sweeps."""

from topicloom.models.base import LDA, load_model, loads_model
from topicloom.models.conditioned import DMR, GDMR, LLDA, PLDA, SLDA
from topicloom.models.nonparametric import HDP, HLDA
from topicloom.models.structured import CT, DT, HPA, MGLDA, PA, PT

__all__ = ["CT", "DMR", "DT", "GDMR", "HDP", "HLDA", "HPA", "LDA", "LLDA", "MGLDA", "PA", "PLDA", "PT", "SLDA", "load_model", "loads_model"]
