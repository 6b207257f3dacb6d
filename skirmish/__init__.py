"""Skirmish: analytics over combat-event logs, written as Spark DataFrame plans."""
