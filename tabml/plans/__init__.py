"""Compositions of operators: training, cross-validation, tuning, leaderboards, explanations."""
