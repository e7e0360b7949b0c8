"""Messy-table reconstruction and logistics analytics as Spark DataFrame jobs."""
