"""DataFrame -> DataFrame operators. Each is lazy unless its docstring says it materialises."""
