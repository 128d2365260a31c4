"""Operators over DataFrames: neighbours, spanning trees, gaps, calibration, scores, sequences, signals and clusters."""
