"""Paths of shared storage, as Python tasks reach them."""

from __future__ import annotations

import glob
import os
import posixpath
import re
from urllib.parse import unquote, urlparse

import pyarrow.fs as fs


def is_local(path: str) -> bool:
    return urlparse(path).scheme in ("", "file")


def local(path: str) -> str:
    """A local path of a ``file:`` URI or of a path as it is."""
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme == "file" else path


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return (fs.LocalFileSystem(), local(path)) if is_local(path) else fs.FileSystem.from_uri(path)


def join(folder: str, *names: str) -> str:
    return os.path.join(folder, *names) if is_local(folder) else posixpath.join(folder, *names)


def walk(path: str, recursive: bool = True) -> list[str] | None:
    """Files at a path or URI, in order: the file itself, or those of a directory; None if
    nothing is there.  Names keep the scheme they were asked for with."""
    system, inner = filesystem(path)
    info = system.get_file_info(inner)
    if info.is_file:
        return [path]
    if info.type == fs.FileType.NotFound:
        return None
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ("" if is_local(path) else path.split("://", 1)[0] + "://")
    found = system.get_file_info(fs.FileSelector(inner, recursive=recursive))
    return sorted((prefix + x.path for x in found if x.is_file), key=lambda f: f.split("/"))


def matching(pattern: str) -> list[str]:
    """Files that a glob matches, ``**`` reaching any depth; the walk begins where the pattern does."""
    steps = pattern.split("/")
    fixed = next((i for i, x in enumerate(steps) if set(x) & set("*?[")), len(steps) - 1)
    root = "/".join(steps[:fixed]) or ("/" if pattern.startswith("/") else ".")
    wanted = re.compile(glob.translate(pattern if root != "." else "./" + pattern, recursive=True, include_hidden=True))
    return [f for f in walk(root) or [] if wanted.match(f)]


def put_text(path: str, text) -> None:
    """Writes pieces of text; the file appears under its name when complete, in a folder made if missing."""
    system, inner = filesystem(path)
    if folder := posixpath.dirname(inner):
        system.create_dir(folder, recursive=True)
    with system.open_output_stream(inner + ".tmp") as out:
        for piece in text:
            out.write(piece.encode())
    system.move(inner + ".tmp", inner)
