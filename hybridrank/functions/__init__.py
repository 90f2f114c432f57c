"""Column builders and Arrow kernels shared by the operators."""
