"""Sorted key arrays with values in shared storage, written by tasks and memory-mapped by others."""

from __future__ import annotations

import io
import tempfile
import uuid
from collections import OrderedDict

import numpy as np
from pyarrow import fs

#: Files a worker keeps mapped.
MAPPED = 512


def _write(folder: str, name: str, array: np.ndarray) -> None:
    """Write under a name of its own and rename: a repeated task attempt replaces the file by an equal one."""
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    content = io.BytesIO()
    np.lib.format.write_array(content, np.ascontiguousarray(array), allow_pickle=False)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(content.getbuffer())
    system.move(draft, f"{path}/{name}.npy")


def _mapped(folder: str, name: str) -> np.ndarray:
    system, path = fs.FileSystem.from_uri(folder)
    path = f"{path}/{name}.npy"
    if isinstance(system, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    # A store that cannot be mapped is copied once; the unlinked copy lives as long as the mapping.
    with tempfile.NamedTemporaryFile(suffix=".npy") as copy, system.open_input_stream(path) as source:
        while block := source.read(1 << 22):
            copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")


def write_part(folder: str, part: int, keys: np.ndarray, **values: np.ndarray) -> None:
    """Write one part of a table: sorted keys and arrays along them."""
    for name, array in values.items():
        _write(folder, f"{part}-{name}", array)
    _write(folder, f"{part}-keys", keys)


class SortedArrays:
    """A table in parts, looked up with sorted keys. A worker's own; parts are mapped when first asked."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.open: OrderedDict[str, np.ndarray] = OrderedDict()

    def _get(self, name: str) -> np.ndarray:
        if name in self.open:
            self.open.move_to_end(name)
        else:
            self.open[name] = _mapped(self.folder, name)
            if len(self.open) > MAPPED:
                self.open.popitem(last=False)
        return self.open[name]

    def find(self, part: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of keys in a part, and whether each is there."""
        own = self._get(f"{part}-keys")
        if not len(own):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return place, own[place] == keys

    def values(self, part: int, name: str, places: np.ndarray) -> np.ndarray:
        return self._get(f"{part}-{name}")[places]
