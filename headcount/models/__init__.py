"""Count regressions on factor regressors, fitted from distributed aggregates.

The raw table is read once, into cells (factor levels, outcome, n). Every fitting step is then one
Spark aggregation over the cells; the driver holds coefficients and a coefficient-by-coefficient
matrix, whose size depends on the number of levels and not on the data.
"""
