"""Training-corpus operators: one module an operator, `queries` registers them."""
