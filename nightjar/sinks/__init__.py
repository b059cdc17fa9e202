"""Exporters."""
