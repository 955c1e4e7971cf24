"""cairnstat: feature-by-observation statistics on Spark DataFrames.

Measurements are held as long tables (feature, obs, value); every operator is
a lazy DataFrame plan unless it needs a small global fit.
"""

__version__ = "0.1.0"
