"""Quality-control analytics for labelled sensor time series on Spark."""
