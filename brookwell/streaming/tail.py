"""A streaming source of lines that are appended to files, as a Python data source.

``spark.dataSource.register(Tail)``, then
``spark.readStream.format("tail").option("path", folder).load()``. Offsets are byte
positions behind whole lines; a stream that starts without a checkpoint begins at the
end of what is there (``from`` = ``start`` for the beginning) and goes on at its offset
after a restart. The driver and the executors read the files themselves, so the folder
must be shared. A file that has become shorter was rotated and is read anew.
"""

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: A task reads about this many bytes.
PART = 64 << 20


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int
    first: bool


def whole_lines(path: str, upto: int) -> int:
    """The position behind the last line end before ``upto``."""
    with open(path, "rb") as f:
        while upto > 0:
            at = max(0, upto - 65_536)
            f.seek(at)
            found = f.read(upto - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            upto = at
    return 0


def lines_from(path: str, start: int, end: int, first: bool) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines that begin from ``start`` on and before ``end``. Unless it is the ``first`` part, a line that began before is the part's before."""
    with open(path, "rb") as f:
        f.seek(start if first else start - 1)
        if not first:
            f.readline()
        while (at := f.tell()) < end and (line := f.readline()):
            yield at, line.rstrip(b"\r\n")


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.suffix, self.part = options.get("suffix", ".log"), int(options.get("part", PART))
        self.from_start = options.get("from", "end") == "start"

    def _files(self) -> list[str]:
        if os.path.isfile(self.folder):
            return [self.folder]
        return sorted(os.path.join(self.folder, f) for f in os.listdir(self.folder) if f.endswith(self.suffix)) if os.path.isdir(self.folder) else []

    def _ends(self) -> dict[str, int]:
        return {f: whole_lines(f, os.path.getsize(f)) for f in self._files()}

    def initialOffset(self) -> dict:
        return {"files": json.dumps({} if self.from_start else self._ends())}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(self._ends())}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        before, out = json.loads(start["files"]), []
        for path, upto in json.loads(end["files"]).items():
            at = before.get(path, 0)
            begin = at = at if at <= upto else 0
            while at < upto:
                out.append(Part(path, at, min(upto, at + self.part), at == begin))
                at += self.part
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        for at, line in lines_from(part.path, part.start, part.end, part.first):
            yield part.path, at, line.decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    """Lines as (path, position, value)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, position long, value string"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(self.options)
