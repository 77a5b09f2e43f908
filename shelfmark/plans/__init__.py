"""Cleaning flows and business questions, composed from operators."""
