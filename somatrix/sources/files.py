"""Rendered images as files: one file an image, written by the tasks that hold them."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a strip, about.
STRIP = 1 << 16


def encode_tiff(image: np.ndarray) -> bytes:
    """A baseline TIFF file, uncompressed, of an array (height, width, channels) of bytes: gray, or red, green, blue, with or
    without alpha."""
    height, width, channels = image.shape
    lines = max(1, STRIP // max(1, width * channels))
    strips = [image[at : at + lines].tobytes() for at in range(0, height, lines)]
    sizes = [len(s) for s in strips]
    starts = [8 + sum(sizes[:i]) for i in range(len(sizes))]
    short, long = 3, 4
    tags = [(256, long, [width]), (257, long, [height]), (258, short, [8] * channels), (259, short, [1]), (262, short, [1 if channels == 1 else 2]), (273, long, starts)]
    tags += [(277, short, [channels]), (278, long, [lines]), (279, long, sizes), (284, short, [1])]
    if channels == 4:
        tags.append((338, short, [2]))
    data = b"".join(strips)
    data += b"\0" * (len(data) % 2)
    at = 8 + len(data)
    extra, directory = b"", struct.pack("<H", len(tags))
    beyond = at + 2 + 12 * len(tags) + 4
    for tag, kind, values in tags:
        packed = struct.pack(f"<{len(values)}{'H' if kind == short else 'I'}", *values)
        if len(packed) > 4:
            place, extra = struct.pack("<I", beyond + len(extra)), extra + packed + b"\0" * (len(packed) % 2)
        else:
            place = packed.ljust(4, b"\0")
        directory += struct.pack("<HHI", tag, kind, len(values)) + place
    return b"II*\0" + struct.pack("<I", at) + data + directory + struct.pack("<I", 0) + extra


class _Writer(DataSourceWriter):
    """Each row's bytes under a name of their own first, then under the row's: a task that runs again does no harm."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(self.folder)
        system.create_dir(root)
        for row in iterator:
            if not row["name"] or "/" in row["name"]:
                raise ValueError(f"not a file name: {row['name']}")
            part = f"{root}/.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write(bytes(row["content"]))
            target = f"{root}/{row['name']}"
            if system.get_file_info(target).type != fs.FileType.NotFound:  # not every file system moves over a file
                system.delete_file(target)
            system.move(part, target)
        return WriterCommitMessage()


class ImageFiles(DataSource):
    """``df.write.format("image_files")``: rows (name, content) as files below the path."""

    @classmethod
    def name(cls) -> str:
        return "image_files"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write_images(files: DataFrame, folder: str) -> None:
    """Write ``files`` (name, content): one file a row below ``folder``, a path or address that all executors reach; files
    of the same names are replaced, others stay. Null or repeated names and names with a slash fail, the first two before
    anything is written; null content gives no file. No rows, no files."""
    if not files.filter(F.col("name").isNull()).isEmpty() or not files.groupBy("name").count().filter("count > 1").isEmpty():
        raise ValueError("names of files are given once each")
    files.sparkSession.dataSource.register(ImageFiles)
    address = folder if "://" in folder else f"file://{quote(folder)}"
    files.select("name", "content").filter("content is not null").write.format("image_files").mode("append").option("path", address).save()
