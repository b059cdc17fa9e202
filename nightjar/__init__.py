"""Nightjar: process-event detection, correlation and alert analytics on Spark."""
