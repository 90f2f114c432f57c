"""Packed vector files, JSON artifacts, dictionary text and configuration.

A packed file is one line of magic, the length of a JSON header as a little-endian
32-bit number, the header (``entries`` lists id and headword of each row), and
the rows: 32-bit floats, or a 32-bit scale and bytes.  A table of many rows is a
folder of such files, read in ranges of rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Fixed value: the line that packed files begin with.
MAGIC = b"CHENGYU_EMBEDDINGS_BIN_V1\n"
ROWS_PER_PARTITION = 50_000


def _header(path: str, magic: bytes = MAGIC) -> tuple[dict, int]:
    with open(path, "rb") as f:
        if f.read(len(magic)) != magic:
            raise ValueError(f"{path}: not a packed file of vectors")
        (n,) = struct.unpack("<I", f.read(4))
        raw = f.read(n)
        if len(raw) != n:
            raise ValueError(f"{path}: the header is cut off")
        return json.loads(raw), f.tell()


def _stride(meta: dict) -> tuple[str, int]:
    """The kind of rows and their length in bytes."""
    small = "i8" in str(meta.get("format", "")) or "int8" in str(meta.get("format", ""))
    return ("i8", meta["dimensions"] + 4) if small else ("f32", meta["dimensions"] * 4)


class _Rows(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _Reader(DataSourceReader):
    def __init__(self, path: str, magic: bytes = MAGIC):
        self.magic = magic
        self.files = sorted(str(p) for p in Path(path).rglob("*.vec")) if os.path.isdir(path) else [path]

    def partitions(self) -> list[InputPartition]:
        out = []
        for file in self.files:
            meta, at = _header(file, self.magic)
            kind, stride = _stride(meta)
            n = len(meta["entries"])
            if os.path.getsize(file) != at + n * stride:
                raise ValueError(f"{file}: the length does not fit {n} rows")
            if kind == "i8" and "vectorHash" in meta:
                digest = hashlib.sha256()
                with open(file, "rb") as f:
                    f.seek(at)
                    for block in iter(lambda: f.read(1 << 20), b""):
                        digest.update(block)
                if digest.hexdigest() != meta["vectorHash"]:
                    raise ValueError(f"{file}: the rows do not fit their hash")
            out += [_Rows(file, lo, min(n, lo + ROWS_PER_PARTITION)) for lo in range(0, n, ROWS_PER_PARTITION)]
        return out

    def read(self, part: _Rows) -> Iterator[tuple]:
        meta, at = _header(part.path, self.magic)
        kind, stride = _stride(meta)
        with open(part.path, "rb") as f:
            f.seek(at + part.first * stride)
            for i in range(part.first, part.last):
                raw, entry = f.read(stride), meta["entries"][i]
                if kind == "f32":
                    scale, vec = None, np.frombuffer(raw, "<f4").tolist()
                else:
                    (scale,) = struct.unpack("<f", raw[:4])
                    vec = np.frombuffer(raw[4:], np.int8).astype(np.float32).tolist()
                    if abs(scale * float(np.linalg.norm(vec)) - 1) > 1e-6:
                        raise ValueError(f"{part.path}: row {i} has a wrong scale")
                yield i, entry.get("id"), entry.get("chengyu"), vec, scale


class _Writer(DataSourceWriter):
    def __init__(self, path: str, kind: str, magic: bytes):
        self.path, self.kind, self.magic = path, kind, magic

    def write(self, rows: Iterator) -> WriterCommitMessage:
        entries, packed, dims = [], [], None
        for r in rows:
            v = np.asarray(r["vec"], np.float64)
            dims = dims or len(v)
            if len(v) != dims or not np.isfinite(v).all():
                raise ValueError(f"vector of {r['id']}: not {dims} finite numbers")
            entries.append({"id": r["id"], "chengyu": r["chengyu"]})
            if self.kind == "f32":
                packed.append(v.astype("<f4").tobytes())
            else:
                q = np.clip(np.floor(v / np.abs(v).max() * 127 + 0.5), -127, 127).astype(np.int8)
                packed.append(struct.pack("<f", 1 / np.linalg.norm(q.astype(np.float64))) + q.tobytes())
        if entries:
            body = b"".join(packed)
            meta = {"version": 1, "format": f"packed-{self.kind}-v1", "dimensions": dims, "entryCount": len(entries), "entries": entries, "vectorHash": hashlib.sha256(body).hexdigest()}
            head = json.dumps(meta).encode()
            os.makedirs(self.path, exist_ok=True)
            file = f"{self.path}/{uuid.uuid4().hex}.vec"
            with open(file + ".tmp", "wb") as f:
                f.write(self.magic + struct.pack("<I", len(head)) + head + body)
            os.rename(file + ".tmp", file)
        return WriterCommitMessage()


class PackedVectors(DataSource):
    """``format("packed_vectors")`` with the options ``path``, ``magic``, and for writing ``kind`` (``f32`` or ``i8``)."""

    @classmethod
    def name(cls) -> str:
        return "packed_vectors"

    def schema(self) -> str:
        return "row long, id string, chengyu string, vec array<float>, scale float"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._magic())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("kind", "f32"), self._magic())

    def _magic(self) -> bytes:
        return self.options["magic"].encode() if "magic" in self.options else MAGIC


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PackedVectors)
    return spark.read.format("packed_vectors").option("path", path).load()


def write_packed(df: DataFrame, path: str, kind: str = "f32") -> None:
    """Writes ``id, chengyu, vec``; each task writes a file of its own, whole or not at all."""
    df.sparkSession.dataSource.register(PackedVectors)
    rows = df.select(F.lit(0).cast("long").alias("row"), "id", "chengyu", F.col("vec").cast("array<float>").alias("vec"), F.lit(None).cast("float").alias("scale"))
    rows.write.format("packed_vectors").option("path", path).option("kind", kind).mode("append").save()


ARTIFACT = "version int, model string, template string, pooling string, normalize boolean, dimensions int, corpusHash string, entryCount int, embeddings array<struct<id:string,chengyu:string,embedding:array<float>>>"


def read_artifact(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The metadata row and the vectors of JSON artifacts."""
    whole = spark.read.schema(ARTIFACT).json(path, multiLine=True)
    return whole.drop("embeddings"), whole.select(F.explode("embeddings").alias("e")).select("e.id", "e.chengyu", F.col("e.embedding").alias("vec"))


#: Fixed value: the form of a dictionary line.
DICTIONARY_LINE = r"^(\S+) (\S+) \[([^\]]+)\] /(.+)/\r?$"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """``(traditional, simplified, pinyin, definitions)`` of the well-formed lines of dictionary text files, plain or gzipped."""
    form = DICTIONARY_LINE
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & F.col("value").rlike(form))
    part = lambda i: F.regexp_extract("value", form, i)
    return lines.select(part(1).alias("traditional"), part(2).alias("simplified"), F.replace(part(3), F.lit("u:"), F.lit("ü")).alias("pinyin"), F.filter(F.split(part(4), "/"), lambda d: d != "").alias("definitions"))


def deep_merge(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``, dictionary by dictionary; neither is changed."""
    return base | {k: deep_merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def load_config(base: dict, *overrides: str | dict) -> dict:
    """``base`` under overrides given as dictionaries, inline JSON, or paths of JSON files, later ones first."""
    for o in overrides:
        text = o if isinstance(o, str) else ""
        value = o if isinstance(o, dict) else json.loads(text if text.lstrip().startswith("{") else Path(text).read_text())
        base = deep_merge(base, value)
    return base
