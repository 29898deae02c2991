"""Files of any store that all workers reach, by their URI."""

from __future__ import annotations

import re


def file_system(path: str):
    """The file system of ``path`` and the path in it; a path without scheme is local."""
    from pyarrow import fs

    if re.match(r"[a-z][a-z0-9+.-]*:", path) and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
