"""Query plans: named queries over the test-data views and their SQL oracle."""
