"""File systems that tasks open by themselves, by the address of a shared folder."""

from __future__ import annotations

from pyarrow import fs


def open_place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of an address: a plain path, file:, hdfs: or an object store.

    Spark's names of the object store connector, ``s3a:`` and ``s3n:``, are Arrow's ``s3:``.
    """
    scheme, colon, rest = uri.partition(":")
    if colon and scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    return fs.FileSystem.from_uri(uri)
