"""Whole jobs put together from operators: the pipeline and the registered queries."""
