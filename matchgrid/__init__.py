"""Spark library for spatio-temporal detection tables of sports video."""
