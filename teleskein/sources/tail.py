"""A streaming source that follows growing files of lines.

Spark's own file source reads a file once; a collector keeps appending to the same file. This
source keeps a byte offset per file, reads only complete lines beyond it, and cuts large
stretches into several partitions that start and end on line borders.

The stream's offset is a version number, whatever the number of files. What it stands for lies
in a folder of small files: ``delta-<version>`` holds the stretches that a version adds, one
line a file, written before the version is handed out; every ``SNAPSHOT_EVERY`` versions
``snap-<version>`` holds all offsets, without those of files that are gone by then. A file that
comes back after it was forgotten is read from its start.

A gzip file is followed by whole members: it has to appear whole, as Spark's writers make it, or
to grow by whole members that begin with a new line. Its offset counts compressed bytes.
"""

from __future__ import annotations

import json
import logging
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from teleskein.sources import paths

READ_BYTES = 4 << 20
SPLIT_BYTES = 64 << 20
log = logging.getLogger(__name__)
# Versions between two snapshots of all offsets.
SNAPSHOT_EVERY = 32
# Files looked at side by side for their last newline.
PROBES = 32
# Of the compressed files only these can be followed; each member begins like this.
GZIP, MEMBER = ".gz", b"\x1f\x8b\x08"


@dataclass
class Stretch(InputPartition):
    """Lines that begin in ``[start, end)``; ``whole_start``: a line begins at ``start``.
    Nothing is read at or behind ``upto``, where the file's last line ends."""

    path: str
    start: int
    end: int
    whole_start: bool
    upto: int


class TailSource(DataSource):
    """``format("tail_lines")``: options ``path``, ``positions``, the folder that keeps the
    offsets, ``version``, the one that a restarted query continues from, ``split_bytes``,
    ``max_bytes`` per trigger, and ``final_line``: a file's rest without a newline counts as a
    line if it is one whole JSON value.

    All files below the path are followed but hidden ones, as Spark's readers do; a file that is
    compressed otherwise than by gzip has no offsets to follow and is an error."""

    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "file string, line binary"

    def streamReader(self, schema: StructType) -> "TailReader":
        return TailReader(self.options)


def last_line_end(system, path: str, size: int, floor: int) -> int:
    """Offset just past the last newline in ``[floor, size)``, searching from the end."""
    with system.open_input_file(path) as handle:
        end = size
        while end > floor:
            begin = max(floor, end - READ_BYTES)
            at = handle.read_at(end - begin, begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            end = begin
    return floor


def is_whole(system, path: str, begin: int, size: int) -> bool:
    """Whether the rest of a file is one JSON value."""
    with system.open_input_file(path) as handle:
        rest = handle.read_at(size - begin, begin)
    try:
        json.loads(rest)
    except ValueError:
        return False
    return True


def check_member(system, path: str, begin: int) -> None:
    """An error where no gzip member begins."""
    with system.open_input_file(path) as handle:
        if handle.read_at(len(MEMBER), begin) != MEMBER:
            raise ValueError(f"{path} is compressed and cannot be followed: no gzip member begins at byte {begin}")


class Positions:
    """Byte offsets of all followed files, by version."""

    def __init__(self, folder: str, version: int = 0) -> None:
        self.folder, self.version = folder, version
        self.offsets: dict[str, int] = {}
        for name in position_files(folder, version):
            self.offsets.update((path, end) for path, _, end in self._lines(name))

    def _lines(self, name: str) -> Iterator[tuple[str, int, int]]:
        for line in paths.read_text(f"{self.folder}/{name}").splitlines():
            entry = json.loads(line)
            yield entry["path"], entry["begin"], entry["end"]

    def _put(self, name: str, entries: Iterator[tuple[str, int, int]]) -> None:
        lines = (json.dumps({"path": p, "begin": b, "end": e}) + "\n" for p, b, e in entries)
        paths.put_text(self.folder, name, lines)

    def advance(self, moved: dict[str, tuple[int, int]], present: set[str]) -> None:
        """The next version: ``moved`` gives the stretch that each changed file adds."""
        self.version += 1
        self._put(f"delta-{self.version:012d}.jsonl", ((p, b, e) for p, (b, e) in sorted(moved.items())))
        self.offsets.update((p, e) for p, (_, e) in moved.items())
        if self.version % SNAPSHOT_EVERY == 0:
            self.offsets = {p: e for p, e in self.offsets.items() if p in present}
            self._put(f"snap-{self.version:012d}.jsonl", ((p, 0, e) for p, e in sorted(self.offsets.items())))

    def stretches(self, start: int, end: int) -> Iterator[tuple[str, int, int]]:
        """What the versions after ``start`` up to ``end`` add."""
        for version in range(start + 1, end + 1):
            yield from self._lines(f"delta-{version:012d}.jsonl")

    def forget(self, version: int) -> None:
        """Drop the files that neither ``version`` nor a later one needs."""
        needed = set(position_files(self.folder, version))
        for name in paths.children(self.folder):
            if name.endswith(".jsonl") and not name.startswith(".") and _number(name) <= version and name not in needed:
                paths.drop_file(f"{self.folder}/{name}")


def _number(name: str) -> int:
    return int(name.split("-")[1].split(".")[0])


def position_files(folder: str, version: int) -> list[str]:
    """The newest snapshot up to ``version`` and the deltas after it, in order."""
    found = sorted(n for n in paths.children(folder) if n.endswith(".jsonl") and not n.startswith(".") and _number(n) <= version)
    snaps = [n for n in found if n.startswith("snap-")]
    since = _number(snaps[-1]) if snaps else 0
    return snaps[-1:] + [n for n in found if n.startswith("delta-") and _number(n) > since]


class TailReader(DataSourceStreamReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.max_bytes = int(options.get("max_bytes", 0))
        self.final_line = str(options.get("final_line", "false")).lower() == "true"
        self.positions = Positions(options["positions"], int(options.get("version", 0)))
        self.served = ""

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        """A new version where complete lines have been added. A file that has become shorter
        than its offset starts over."""
        system, _ = paths.resolve(self.path)
        known_offsets, moved = self.positions.offsets, {}
        budget = self.max_bytes or None
        found = paths.sizes(self.path)
        changed = [(path, size) for path, size in sorted(found.items()) if size != known_offsets.get(path, 0)]
        if packed := [path for path, _ in changed if path.endswith(paths.COMPRESSED) and not path.endswith(GZIP)]:
            raise ValueError(f"{packed[0]} is compressed and cannot be followed; read it with scan_all")
        # With a budget every file gets its turn: begin behind the one served last.
        changed = [c for c in changed if c[0] > self.served] + [c for c in changed if c[0] <= self.served]

        def complete(item: tuple[str, int]) -> tuple[str, int, int]:
            path, size = item
            known = known_offsets.get(path, 0)
            start = known if size > known else 0
            if size < known:
                log.warning("%s was cut from %d to %d bytes; it is read from its start again", path, known, size)
            if path.endswith(GZIP):
                if size:
                    check_member(system, path, start)
                return path, start, size
            end = last_line_end(system, path, size, start)
            if self.final_line and end < size and is_whole(system, path, end, size):
                end = size
            return path, start, end

        with ThreadPoolExecutor(PROBES) as pool:
            for at in range(0, len(changed), PROBES):
                if budget == 0:
                    break
                for path, start, end in pool.map(complete, changed[at : at + PROBES]):
                    if budget == 0:
                        break
                    if budget is not None and end - start > budget and path.endswith(GZIP):
                        if moved:  # whole in the next version, which begins with it
                            budget = 0
                            break
                    elif budget is not None and end - start > budget:
                        # Whole lines within the budget, or one line if that alone is larger.
                        fitted = last_line_end(system, path, start + budget, start)
                        end = fitted if fitted > start else next_line(system, path, start, end)
                    if budget is not None:
                        budget = max(0, budget - (end - start))
                        self.served = path
                    if end > start or start < known_offsets.get(path, 0):
                        moved[path] = start, end
        if moved:
            self.positions.advance(moved, set(found))
        return {"version": self.positions.version}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, begin, upto in self.positions.stretches(start["version"], end["version"]):
            if path.endswith(GZIP):
                out += [Stretch(path, begin, upto, True, upto)] * (upto > begin)
                continue
            for at in range(begin, upto, self.split_bytes):
                out.append(Stretch(path, at, min(at + self.split_bytes, upto), at == begin, upto))
        return out

    def commit(self, end: dict) -> None:
        # Up to the version before, which a repeat of the last micro-batch starts from.
        self.positions.forget(end["version"] - 1)

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        system, _ = paths.resolve(self.path)
        with system.open_input_file(partition.path) as handle:
            packed = partition.path.endswith(GZIP)
            for lines in member_lines(handle, partition) if packed else line_batches(handle, partition, self.final_line):
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(partition.path), len(lines)), pa.array(lines, pa.binary())],
                    names=["file", "line"],
                )


def inflated(handle, part: Stretch) -> Iterator[bytes]:
    """The text of the stretch's gzip members in pieces of bounded size."""
    at, packed, member = part.start, b"", zlib.decompressobj(zlib.MAX_WBITS | 16)
    while True:
        piece = member.decompress(packed, READ_BYTES)
        if piece:
            yield piece
        packed = member.unused_data if member.eof else member.unconsumed_tail
        if not packed and len(piece) < READ_BYTES:
            packed = handle.read_at(min(READ_BYTES, part.upto - at), at) if at < part.upto else b""
            at += len(packed)
            if not packed:
                break
        if member.eof and packed:
            member = zlib.decompressobj(zlib.MAX_WBITS | 16)
    # Where less was read, the file was changed since its offset was taken.
    if not member.eof and at == part.upto:
        raise ValueError(f"{part.path} is compressed and ends inside a gzip member at byte {part.upto}; it has to appear whole")


def member_lines(handle, part: Stretch) -> Iterator[list[bytes]]:
    """All lines of the stretch's gzip members, the last one also without its newline."""
    pending: list[bytes] = []
    for piece in inflated(handle, part):
        head, newline, rest = piece.rpartition(b"\n")
        if newline:
            yield (b"".join(pending) + head).split(b"\n")
            pending = [rest]
        else:
            pending.append(piece)
    if any(pending):
        yield [b"".join(pending)]


def next_line(system, path: str, start: int, end: int) -> int:
    """Offset just past the first newline at or after ``start``."""
    with system.open_input_file(path) as handle:
        while start < end:
            piece = handle.read_at(min(READ_BYTES, end - start), start)
            if not piece:
                break
            at = piece.find(b"\n")
            if at >= 0:
                return start + at + 1
            start += len(piece)
    return end


def line_batches(handle, part: Stretch, final_line: bool = False) -> Iterator[list[bytes]]:
    """Lines that begin within the stretch. The last one may run on past its end; with
    ``final_line`` what stands before ``upto`` without a newline is a line too."""
    at = part.start
    pending: list[bytes] = []  # the open line's blocks, joined once it ends
    if not part.whole_start:
        # The line across the border belongs to the stretch before: begin after the first
        # newline at or behind the byte before the start.
        at, skipping = part.start - 1, True
    else:
        skipping = False
    while True:
        piece = handle.read_at(min(READ_BYTES, part.upto - at), at) if at < part.upto else b""
        if not piece:
            # A rest is a final line, or else the file was changed since its offset was taken.
            if final_line and any(pending) and at == part.upto:
                yield [b"".join(pending)]
            return
        if skipping:
            cut = piece.find(b"\n")
            at += len(piece) if cut < 0 else cut + 1
            skipping = cut < 0
            if at >= part.end:
                return
            continue
        limit = part.end - at
        at += len(piece)
        if len(piece) >= limit:
            # The stretch ends here, or with the line that is open at its end.
            on_border = limit > 0 and piece[limit - 1 : limit] == b"\n"
            stop = limit if on_border else piece.find(b"\n", max(limit, 0)) + 1
            if stop > 0:
                yield (b"".join(pending) + piece[:stop]).split(b"\n")[:-1]
                return
        head, newline, rest = piece.rpartition(b"\n")
        if newline:
            yield (b"".join(pending) + head).split(b"\n")
            pending = [rest]
        else:
            pending.append(piece)
