"""Passenger-flow analytics on Spark DataFrames."""
