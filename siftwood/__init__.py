"""Listing intelligence on Spark: normalise, gate, score, merge and digest listing records with DataFrame operators."""
