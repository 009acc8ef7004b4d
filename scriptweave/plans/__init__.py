"""The catalogue: inputs, named queries, and the SQL each is checked against."""
