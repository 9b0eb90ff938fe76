"""Turnloom: analytics over conversation logs and model-evaluation tables, written for Spark."""
