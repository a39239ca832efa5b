"""File systems by path, as Python data sources reach them from the driver and from tasks."""

from __future__ import annotations

import re


def system_of(path: str):
    """pyarrow's file system and the path in it, of a local path or a URI of a store that all of the cluster shares."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def names_of(path: str, suffix: str) -> list[str]:
    """Paths below a folder that end in suffix, in order; none if there is no folder."""
    from pyarrow import fs

    system, root = system_of(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(f.path for f in found if f.path.endswith(suffix) and f.is_file)
