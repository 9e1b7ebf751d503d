"""Governed rule analytics on Spark: rules compiled to DataFrame plans, evaluated over whole batches of cases."""
