"""Text of office and plain files from their bytes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filesystem import text_of

_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_text(data: bytes) -> str | None:
    """The cells of a workbook: a row's values joined by blanks, rows and sheets by line ends; None where the bytes are no workbook."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = set(z.namelist())
            shared = []
            if "xl/sharedStrings.xml" in names:
                for item in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                    shared.append("".join(t.text or "" for t in item.iter(f"{_NS}t")))
            sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
            out = []
            for sheet in sheets:
                for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_NS}row"):
                    cells = []
                    for c in row.iter(f"{_NS}c"):
                        kind, value = c.get("t"), c.find(f"{_NS}v")
                        if kind == "inlineStr":
                            cells.append("".join(t.text or "" for t in c.iter(f"{_NS}t")))
                        elif value is not None and value.text is not None:
                            cells.append(shared[int(value.text)] if kind == "s" else value.text)
                    if cells:
                        out.append(" ".join(cells))
            return "\n".join(out)
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, IndexError, ValueError):
        return None


def texts(contents: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """path and text of contents (path, content): workbooks by their cells, the given extensions as UTF-8 or Latin-1, null for others.

    Only workbooks go through Python; the rest is decoded by the engine.
    """
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    plain = contents.where(extension != ".xlsx").select("path", F.when(extension.isin(*extensions), text_of(F.col("content"))).alias("text"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"path": f["path"], "text": [None if c is None else workbook_text(bytes(c)) for c in f["content"]]})

    return plain.unionByName(contents.where(extension == ".xlsx").select("path", "content").mapInPandas(read, "path string, text string"))
