"""Catalogue search, health telemetry, moderation and roll-ups as Spark DataFrame plans."""
