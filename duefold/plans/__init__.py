"""Whole analyses built from the operators."""
