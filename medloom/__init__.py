"""Personal health record jobs for Spark, DataFrame in and DataFrame out."""
