"""Charge auditing on Spark: catalog, redaction, lookup, rules and reports."""
