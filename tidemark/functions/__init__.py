"""Column expressions: costs, moments, normal distribution."""
