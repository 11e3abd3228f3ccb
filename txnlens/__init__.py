"""Find unusual and accidental payments in large transaction tables with Spark."""
