"""Readers and writers of typed tables."""

from .files import csv_load, csv_store, infer_row, load, parquet

__all__ = ["csv_load", "csv_store", "infer_row", "load", "parquet"]
