"""Ledgerline: agent-session forensics and corpus processing on Spark DataFrames."""
