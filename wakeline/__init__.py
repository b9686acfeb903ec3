"""Vessel-gap analytics on Spark DataFrames."""

from wakeline.params import Params

__all__ = ["Params"]
