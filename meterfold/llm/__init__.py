"""Training-data operators: each is a Spark job over a documents-like table."""
