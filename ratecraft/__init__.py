"""Payout reconciliation on rate cards, as PySpark DataFrame operators."""
