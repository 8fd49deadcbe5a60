"""Ordered feature chains, reports and the registered queries."""
