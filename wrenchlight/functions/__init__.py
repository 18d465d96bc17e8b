"""Column functions. Built-in expressions only, so they stay inside codegen."""
