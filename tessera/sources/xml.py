"""XML files as a table of elements, which the readers of descriptors then query like any other table."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.shipping import ship

ELEMENTS = "path string, node int, parent int, depth int, tag string, text string, uuid string, attributes map<string,string>, error string"


def files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """`path` (below `root`), `content`: all files under a folder whose names match; Spark passes over empty ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    marker = root.rstrip("/").rpartition("/")[2] + "/"
    return found.select(F.regexp_replace(F.substring_index(F.col("path"), marker, -1), "^/", "").alias("path"), "content")


def parse(content: bytes) -> list[tuple]:
    """Elements in page order: number, number of the parent (-1), depth, local name, text, uuid, attributes.

    Namespaces are left out of names; white space around a text is trimmed. Raises on XML that isn't well-formed.
    """
    rows: list[list] = []
    stack: list[int] = []
    parser = expat.ParserCreate(namespace_separator=" ")

    def start(name: str, attributes: dict) -> None:
        local = {k.rpartition(" ")[2]: v for k, v in attributes.items()}
        rows.append([len(rows), stack[-1] if stack else -1, len(stack), name.rpartition(" ")[2], "", local.get("uuid"), local])
        stack.append(len(rows) - 1)

    def data(text: str) -> None:
        rows[stack[-1]][4] += text

    parser.StartElementHandler, parser.CharacterDataHandler = start, data
    parser.EndElementHandler = lambda _: stack.pop()
    parser.buffer_text = True
    parser.Parse(content, True)
    return [(*r[:4], r[4].strip(), r[5], list(r[6].items())) for r in rows]


def elements(found: DataFrame) -> DataFrame:
    """The elements of all `found` files (`path`, `content`); a file that isn't XML is one row with `error`."""
    ship(found.sparkSession)
    names = ["path", "node", "parent", "depth", "tag", "text", "uuid", "attributes", "error"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(path, *r, None) for r in parse(content)]
                except expat.ExpatError as e:
                    rows = [(path, None, None, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return found.select("path", "content").mapInArrow(run, ELEMENTS)
