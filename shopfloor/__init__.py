"""Offline-retail analytics as Spark DataFrame operators."""
