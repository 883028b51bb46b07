"""Column-expression functions shared by the operators."""
