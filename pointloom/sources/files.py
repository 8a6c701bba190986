"""Files on any store that Arrow opens, in byte ranges."""

from __future__ import annotations

import hashlib

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it, of a path or a URI. A local one is taken as it is, as Spark writes it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, suffix: str | None = None) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files by name; with suffix, only of those that end so in either case."""
    store, inner = opened(path)
    head = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner))
    kept = [f for f in found if f.type == fs.FileType.File and (len(found) == 1 or suffix is None or f.path.lower().endswith(suffix))]
    return sorted((head + f.path, f.size) for f in kept if not f.base_name.startswith((".", "_")))


def read_range(path: str, offset: int, size: int) -> bytes:
    store, inner = opened(path)
    with store.open_input_file(inner) as f:
        return f.read_at(size, offset)


def join_parts(parts: list[str], target: str, head: bytes = b"") -> None:
    """Write head and the parts, in order, to target and remove the parts. Copies by the megabyte."""
    store, inner = opened(target)
    with store.open_output_stream(inner) as out:
        out.write(head)
        for part in parts:
            with store.open_input_stream(opened(part)[1]) as f:
                while block := f.read(1 << 20):
                    out.write(block)
    remove(parts)


def name_parts(parts: list[str], folder: str, suffix: str) -> None:
    """Number the parts that hold anything, in order, by renaming them; empty ones go."""
    store, _ = opened(folder)
    inner = [opened(p)[1] for p in parts]
    full = [p for p, info in zip(inner, store.get_file_info(inner), strict=True) if info.size]
    for number, part in enumerate(full):
        store.move(part, f"{opened(folder)[1]}/part-{number:08d}{suffix}")
    remove([p for p, i in zip(parts, inner, strict=True) if i not in full])


def digests(path: str) -> tuple[int, str, str]:
    """Size, SHA-256 and MD5 of a file, read by the megabyte."""
    store, inner = opened(path)
    size, sha, md5 = 0, hashlib.sha256(), hashlib.md5(usedforsecurity=False)
    with store.open_input_stream(inner) as f:
        while block := f.read(1 << 20):
            size += len(block)
            sha.update(block)
            md5.update(block)
    return size, sha.hexdigest(), md5.hexdigest()


def remove(parts: list[str]) -> None:
    for part in parts:
        store, inner = opened(part)
        if store.get_file_info(inner).type == fs.FileType.File:
            store.delete_file(inner)


def make_parent(path: str) -> None:
    store, inner = opened(path)
    if "/" in inner.strip("/"):
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)


def make_folder(path: str) -> bool:
    """Make a folder where there is none; whether it holds files."""
    store, inner = opened(path)
    store.create_dir(inner, recursive=True)
    return bool(store.get_file_info(fs.FileSelector(inner)))
