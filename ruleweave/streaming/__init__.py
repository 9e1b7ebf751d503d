"""Screening of streams of cases."""
