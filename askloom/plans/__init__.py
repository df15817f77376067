"""Whole jobs put together from the sources, functions and operators."""
