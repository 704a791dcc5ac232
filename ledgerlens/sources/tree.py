"""The files of a working tree as rows, for scans before publication.

Spark's own file sources leave out names that begin with a dot or an underscore,
which is where settings and package files live, so the files are listed on the
driver (names only) and read by the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..plans.parts import located

#: Folders of tools, which are not published.
LEFT_OUT = (".git", "__pycache__")
#: Files that a task reads, about.
FILES_A_TASK = 64


def tree_files(root: str, left_out: tuple[str, ...] = LEFT_OUT) -> list[str]:
    """Paths below ``root`` of all files, in order."""
    system, top = located(root.rstrip("/"))
    files = (f.path[len(top) :].lstrip("/") for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File)
    return sorted(p for p in files if not set(p.split("/")[:-1]) & set(left_out))


def read_tree(spark: SparkSession, root: str, places: list[str] | None = None) -> DataFrame:
    """``place`` (the path below ``root``) and ``text`` of every file that is
    UTF-8; of the given places, or of all.  Files that aren't text, or are gone,
    are left out."""
    places = tree_files(root) if places is None else places

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, top = located(root.rstrip("/"))
        for batch in batches:
            for place in batch["place"]:
                try:
                    with system.open_input_stream(f"{top}/{place}") as f:
                        text = f.read().decode("utf-8")
                except (FileNotFoundError, IsADirectoryError, UnicodeDecodeError):
                    continue
                yield pd.DataFrame({"place": [place], "text": [text]})

    listed = spark.createDataFrame([(p,) for p in places], "place string").repartition(max(1, -(-len(places) // FILES_A_TASK)))
    return listed.mapInPandas(read, "place string, text string")
