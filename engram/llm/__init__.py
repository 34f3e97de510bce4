"""Training-data operators: ten corpus operators and the queries over them."""
