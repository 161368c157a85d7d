"""Every registered query and its SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from .base import ORACLES, QUERIES

for _part in ("feature_queries", "rating_queries", "asof_queries", "evaluation_queries", "profile_queries", "quality_queries", "identity_queries", "lifecycle_queries", "model_queries"):
    importlib.import_module(f"{__package__}.{_part}")

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides' record, form, rest and head-to-head before every contest."""
    return QUERIES["pre_contest_features"](spark, sf_dir)
