"""Station time-series analytics on Spark.

Every operator is a function from DataFrame to DataFrame.  Operators that depend
on the order of readings work on a *laid-out* frame (see ``operators.ordered``),
whose rows are numbered once across the cluster, so that no station has to fit
into one task.
"""
