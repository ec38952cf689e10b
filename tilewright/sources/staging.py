"""Files that a data source writer stages in its tasks and shows on commit.

A task writes hidden files under a name of its own and reports them. The driver moves the reported
files to their names once every task has ended; what failed, repeated or speculative attempts wrote
never gets a name that a glob matches, and a failed job removes what its tasks reported.
"""

from __future__ import annotations

import posixpath
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

from tilewright.sources.files import make_dirs, move, open_output, remove


@dataclass
class Staged(WriterCommitMessage):
    """(hidden path, final path) of each file of a task."""

    files: list[tuple[str, str]]


class StagedWriter(DataSourceArrowWriter):
    """Subclasses cut the rows of a task into runs, one file for each run of equal ``file_of``."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")
        make_dirs(self.root)

    def runs(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[dict]]]:
        """(file name, rows) of consecutive rows that share a file."""
        rows = (row for batch in batches for row in batch.to_pylist())
        row = next(rows, None)
        while row is not None:
            name, ahead = self.file_of(row), [row]

            def same() -> Iterator[dict]:
                while ahead and ahead[0] is not None and self.file_of(ahead[0]) == name:
                    yield ahead.pop()
                    ahead.append(next(rows, None))

            yield name, same()
            row = ahead[0]

    def file_of(self, row: dict) -> str:
        raise NotImplementedError

    def fill(self, out, rows: Iterator[dict]) -> None:
        """Write the rows of one file to the open stream."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        attempt, done = uuid.uuid4().hex, []
        try:
            for name, rows in self.runs(iterator):
                hidden = posixpath.join(self.root, f".{name}.{attempt}")
                done.append((hidden, posixpath.join(self.root, name)))
                with open_output(hidden) as out:
                    self.fill(out, rows)
            return Staged(done)
        except BaseException:
            _each(remove, [h for h, _ in done])
            raise

    def commit(self, messages: list[Staged | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]  # names only
        finals = [final for _, final in files]
        twice = sorted(f for f, n in Counter(finals).items() if n > 1)[:5]
        if twice:
            _each(remove, [h for h, _ in files])
            raise ValueError(f"rows of one file lie apart, sort them together first: {twice}")
        for hidden, final in files:
            move(hidden, final)

    def abort(self, messages: list[Staged | None]) -> None:
        _each(remove, [h for m in messages if m is not None for h, _ in m.files])


def _each(action: Callable[[str], None], paths: list[str]) -> None:
    for p in paths:
        action(p)
