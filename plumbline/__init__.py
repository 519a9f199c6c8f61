"""Data-quality profiling for Spark DataFrames."""

from plumbline.operators.profile import ProfileOptions, profile_table, profile_tables

__all__ = ["ProfileOptions", "profile_table", "profile_tables"]
