"""Plans of the repository-history engine."""
