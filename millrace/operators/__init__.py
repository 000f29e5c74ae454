"""DataFrame operators, by capability."""
