"""Plan-level helpers shared by the operators (exact ranks, prefix sums)."""
