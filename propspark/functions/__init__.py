"""Column-level building blocks: text cleaning, rule compilation, quantiles and skew handling."""
