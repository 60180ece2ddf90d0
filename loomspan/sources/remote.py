"""File systems of URIs for tasks and the driver, where files are read past Spark's own readers."""

from __future__ import annotations

#: Schemes that Hadoop and pyarrow call by other names.
SAME = {"s3a": "s3", "s3n": "s3"}


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI as Spark writes it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition(":")
    if colon and not rest.startswith("//") and scheme == "file":
        rest = "//" + rest
    return fs.FileSystem.from_uri(f"{SAME.get(scheme, scheme)}{colon}{rest}")
