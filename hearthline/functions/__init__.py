"""Column functions. All are Catalyst expressions; none is a Python UDF."""
