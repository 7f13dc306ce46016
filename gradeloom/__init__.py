"""gradeloom: a learning-evidence analytics engine written as Spark DataFrame programs."""
