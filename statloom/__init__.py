"""statloom: statistics and probabilistic modelling as PySpark DataFrame and SQL operators."""
