"""Reading versioned tables and publishing results under a fixed schema."""
