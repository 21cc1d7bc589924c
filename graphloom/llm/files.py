"""Binary files in shared storage of any kind, written and read by the tasks themselves."""

from __future__ import annotations

from pyarrow import fs


def at(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URL, and the path in it."""
    return fs.FileSystem.from_uri(url)


def write_whole(url: str, attempt: object, chunks) -> int:
    """Writes a file under a name of the attempt's own, then moves it to its place: readers see all of it or nothing, and a repeated task replaces it with the same bytes."""
    system, path = at(url)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own, size = f"{path}.{attempt}.tmp", 0
    with system.open_output_stream(own, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    system.move(own, path)
    return size


def read_range(url: str, start: int, length: int) -> bytes:
    system, path = at(url)
    with system.open_input_file(path) as file:
        return file.read_at(length, start)
