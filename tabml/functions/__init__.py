"""Column rules and distributed order statistics shared by the operators."""
