"""Directional gene-flow analytics expressed as Spark DataFrame jobs.

Every public operator takes DataFrames and returns DataFrames; nothing that grows
with the data passes through the driver.
"""

__version__ = "0.1.0"
