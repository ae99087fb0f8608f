"""Functions of the repository-history engine."""
