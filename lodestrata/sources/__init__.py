"""Sources of the repository-history engine."""
