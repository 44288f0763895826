"""recallgrid: hybrid retrieval, memory dynamics and corpus processing on PySpark."""
