"""Modelling plans composed from the operators."""
