"""Audience tags on Spark: dated tag tables, wide tables, member sets, behaviour features and a label model."""
