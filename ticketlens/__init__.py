"""Support-ticket text analytics as Spark DataFrame operators."""
