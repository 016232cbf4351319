"""End-to-end runs over the operators, and the registered queries."""
