"""Reading and writing graphs and time series."""
