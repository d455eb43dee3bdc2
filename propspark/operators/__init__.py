"""DataFrame-to-DataFrame operators, grouped by theme."""
