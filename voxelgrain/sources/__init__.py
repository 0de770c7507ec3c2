"""Readers and writers: Parquet as the native format, VTK, XDMF, JSON, and HDF5 where h5py is installed."""
