"""Readers and writers: grid files (CDL, netCDF classic), CSV, Parquet."""

from .csv import read_csv
from .grid import GridDataSource, read_grid, register_grid
from .sink import write_csv

__all__ = ["GridDataSource", "read_csv", "read_grid", "register_grid", "write_csv"]
