"""siftwork: declarative clean-up and reconciliation of large libraries on Spark."""
