"""Output tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """Writes each table under its name, one folder per project; an export replaces the former one."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.partitionBy("project_id").save(f"{path}/{name}")


def write_files(files: DataFrame, folder: str) -> int:
    """Writes each row as a file under a shared folder and gives their number. ``files``: ``path`` below the folder, ``content``.

    Tasks write on their own; one that is repeated writes the same files again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                whole = f"{root}/{path}"
                below = whole.rsplit("/", 1)[0]
                if below not in made:
                    system.create_dir(below, recursive=True)
                    made.add(below)
                with system.open_output_stream(whole) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    done = files.select("path", F.col("content").cast("binary")).mapInArrow(run, "n long")
    return done.agg(F.sum("n")).first()[0] or 0
