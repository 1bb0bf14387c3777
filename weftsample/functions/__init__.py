"""Column functions: row hashes, random letters and Poisson draws."""
