"""Panel analytics on Spark DataFrames: (month, cell, value) tables, folds, ridge models and their checks."""
