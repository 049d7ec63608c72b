"""Training-data operators: ten corpus operators as Spark jobs, and the queries that apply them."""
