"""Billing-assurance analytics on Spark."""
