"""freshet: flood-analysis dataflows and corpus operators, written for Spark."""
