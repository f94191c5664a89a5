"""Training-data operators: each module has a general operator and its registered query."""
