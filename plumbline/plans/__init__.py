"""Whole-source plans: the audit and its report tables."""
