"""Catalogs, the Parquet chunk store and the optional HDF5 connector."""
