"""Tables as people send them: CSV with or without a byte order mark, in UTF-8 or CP949, with tabs or commas, and JSON in an envelope.

Files are read by Spark as binary rows, so any store that Spark opens can hold them; each file is decoded and cut into rows in the task
that holds it, and one that is larger than the cap is refused, as it must fit a task.
"""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a file at most.
MOST_BYTES = 64 << 20
#: Rows of a file that is written, about.
ROWS_A_FILE = 20_000
#: Encodings in the order in which they are tried; the first one drops a byte order mark.
ENCODINGS = ("utf-8-sig", "cp949")
#: Keys of an envelope under which rows may stand.
ENVELOPES = ("rows", "items", "value")


def decoded(raw: bytes) -> str:
    for name in ENCODINGS:
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    raise ValueError(f"the bytes are in none of {', '.join(ENCODINGS)}")


def parsed(text: str) -> list[dict]:
    """Rows of a text: JSON if it begins like it, else separated by tabs if the first line has one, else by commas."""
    if text.lstrip().startswith(("{", "[")):
        data = json.loads(text)
        if isinstance(data, dict):
            data = next((data[k] for k in ENVELOPES if k in data), None)
        if not isinstance(data, list) or not all(isinstance(r, dict) for r in data):
            raise ValueError(f"JSON must be a list of objects, or hold one under {', '.join(ENVELOPES)}")
        return data
    head = text.split("\n", 1)[0]
    rows = csv.DictReader(io.StringIO(text), delimiter="\t" if "\t" in head else ",")
    return [{(k or "").strip(): v for k, v in row.items() if k is not None} for row in rows]


def _cell(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def read_tabular(spark: SparkSession, path: str, columns: list[str], most_bytes: int = MOST_BYTES) -> DataFrame:
    """(file, place, columns as text) of all rows of the files at a path; columns that a file doesn't have are null."""
    files = spark.read.format("binaryFile").load(path).where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]"))
    large = files.where(F.col("length") > most_bytes).select("path").take(1)
    if large:
        raise ValueError(f"{large[0].path} has more than {most_bytes} bytes")

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame.path, frame.content, strict=True):
                found = parsed(decoded(raw))
                out = pd.DataFrame({c: [_cell(r.get(c)) for r in found] for c in columns}, dtype=object)
                out.insert(0, "place", range(len(found)))
                out.insert(0, "file", name.rsplit("/", 1)[-1])
                yield out

    schema = "file string, place long, " + ", ".join(f"`{c}` string" for c in columns)
    return files.select("path", "content").mapInPandas(rows, schema)


def write_bytes(df: DataFrame, folder: str) -> None:
    """Writes (name, content) rows as files below a folder of a store that pyarrow opens; under temporary names first."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for frame in frames:
            for name, content in zip(frame.name, frame.content, strict=True):
                held = f"{root}/.{name}.{TaskContext.get().taskAttemptId()}"
                with store.open_output_stream(held, compression=None) as out:
                    out.write(content)
                store.move(held, f"{root}/{name}")
            yield pd.DataFrame({"name": frame.name})

    df.select("name", "content").mapInPandas(write, "name string").write.format("noop").mode("overwrite").save()


def as_file(rows: DataFrame, group: str, kind: str, encoding: str = "utf-8", most: int | None = None) -> DataFrame:
    """(name, content) of the files of each value of ``group``: kind csv, tsv, or the key of a JSON envelope. A group of more than about ``most``
    rows goes into several files, so a task holds a few rows however large a group is."""
    columns, most = rows.columns, float(most or ROWS_A_FILE)
    own = [c for c in columns if c != group]
    end = kind if kind in ("csv", "tsv") else "json"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        if kind in ("csv", "tsv"):
            text = frame[own].to_csv(index=False, sep="," if kind == "csv" else "\t")
        else:
            text = json.dumps({kind: json.loads(frame[own].to_json(orient="records"))}, ensure_ascii=False)
        name, number, of = frame[group].iloc[0], frame["_file"].iloc[0], frame["_files"].iloc[0]
        return pd.DataFrame({"name": [f"{name}.{end}" if of == 1 else f"{name}.{number}.{end}"], "content": [text.encode(encoding)]})

    # a few rows, one for each group; rows without a group have files, too
    files = rows.groupBy(F.col(group).alias("_group")).agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("_files"))
    dealt = rows.withColumn("_h", F.xxhash64(F.monotonically_increasing_id())).join(files, F.col(group).eqNullSafe(F.col("_group")))
    dealt = dealt.select(*columns, "_files", F.pmod("_h", "_files").cast("int").alias("_file"))
    return dealt.groupBy(group, "_file").applyInPandas(pack, "name string, content binary")
