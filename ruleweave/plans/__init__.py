"""Rules as values, and what can be said of a program before it runs: strata and polarities."""
