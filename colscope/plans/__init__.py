"""Whole-table and whole-catalogue analyses composed from the operators."""
