"""Training-data operators: one module for each operator, and the word, graph and block helpers they share."""
