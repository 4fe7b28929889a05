"""Tidemark: drift-aware scoring of transaction tables on Apache Spark."""

from tidemark.params import EvalParams, Roles, TrainParams
from tidemark.session import cut_lineage, get_spark

__all__ = ["EvalParams", "Roles", "TrainParams", "cut_lineage", "get_spark"]
