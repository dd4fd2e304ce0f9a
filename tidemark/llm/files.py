"""Files that tasks write to and read from the shared folder, by any path that Arrow's file systems know.

A task gives each file a name of its own, and its row of the manifest says which files count. A task that runs
twice leaves an orphan, never a file that is counted twice.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def new_file(folder: str, suffix: str) -> str:
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def open_output(path: str):
    system, place = located(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    return system.open_output_stream(place, compression=None)


def open_input(path: str):
    system, place = located(path)
    return system.open_input_file(place)
