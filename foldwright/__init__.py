"""Foldwright: research analytics over tables, written as PySpark DataFrame operators."""
