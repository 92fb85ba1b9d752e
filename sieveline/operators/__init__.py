"""Encoding, sampling, prediction, scoring, clustering, selection and metrics over DataFrames."""
