"""Column expressions and small Arrow helpers used inside the jobs."""
