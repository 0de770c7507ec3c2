"""A small stand-in for the HDF5 library, with the calls that the sources make: one pickled dictionary a file."""

import os
import pickle

import numpy as np


class Dataset:
    def __init__(self, values, attrs=None):
        self.values, self.attrs = values, dict(attrs or {})

    shape = property(lambda self: self.values.shape)
    dtype = property(lambda self: self.values.dtype)

    def __getitem__(self, at):
        return self.values[at]

    def __setitem__(self, at, values):
        self.values[at] = values


class File:
    def __init__(self, name, mode="r"):
        if mode == "r" and not os.path.exists(name):
            raise FileNotFoundError(name)
        self.name, self.mode = name, mode
        self.held = {}
        if os.path.exists(name):
            with open(name, "rb") as file:
                self.held = pickle.load(file)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        if self.mode != "r":
            with open(self.name, "wb") as file:
                pickle.dump(self.held, file)

    def __contains__(self, path):
        return path.strip("/") in self.held

    def __getitem__(self, path):
        return self.held[path.strip("/")]

    def __delitem__(self, path):
        del self.held[path.strip("/")]

    def create_dataset(self, path, shape=None, dtype=None, data=None, **options):
        made = Dataset(np.array(data) if data is not None else np.zeros(shape, dtype))
        made.options = options
        self.held[path.strip("/")] = made
        return made

    def copy(self, path, target, name):
        own = self[path]
        target.held[name.strip("/")] = Dataset(own.values.copy(), own.attrs)

    def visititems(self, visit):
        for path, node in sorted(self.held.items()):
            visit(path, node)
