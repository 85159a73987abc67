"""Frame-metric, embedding and pipeline-selection analytics on Spark DataFrames."""
