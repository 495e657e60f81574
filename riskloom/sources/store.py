"""A store of fitted models: found by what they were fitted from, so that a changed input is fitted anew.

A model's key is the digest of the input files (path, size, modification time), its parameters and the
library's own sources. Its files go to a fresh folder under the key; the manifest that names the folder is
written last, by a rename. A reader without a manifest sees nothing, and of two writers at a time either's files are whole.
"""

from __future__ import annotations

import hashlib
import json
import pathlib
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir

STORE_CONF = "spark.riskloom.store.dir"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def input_state(spark: SparkSession, paths: Sequence[str]) -> list[list]:
    """[path, bytes, modification time] of every file under ``paths``, in any store that Spark reads."""
    out = []
    for path in paths:
        fs, p = _file_system(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            out.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def library_digest() -> str:
    """Digest of the library's sources: models of another version are not taken."""
    root = pathlib.Path(__file__).resolve().parents[1]
    h = hashlib.sha256()
    for part in ("functions", "operators", "plans", "sources"):
        for f in sorted((root / part).glob("*.py")):
            h.update(f.name.encode() + b"\0" + f.read_bytes())
    return h.hexdigest()


class ModelStore:
    """Models under ``root``: by default the folder of ``spark.riskloom.store.dir``, else one in the shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or spark.conf.get(STORE_CONF, None) or f"{ensure_checkpoint_dir(spark).rstrip('/')}/riskloom-models").rstrip("/")

    def key(self, inputs: Sequence[str], **params) -> str:
        parts = {"inputs": input_state(self.spark, inputs), "params": params, "library": library_digest()}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()

    def find(self, key: str) -> str | None:
        """The folder of the model with this key, if it was written whole."""
        path = f"{self.root}/{key}/manifest.json"
        fs, p = _file_system(self.spark, path)
        if not fs.exists(p):
            return None
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])["path"]

    def put(self, key: str, save: Callable[[str], None]) -> str:
        """Let ``save`` write the model's files to a fresh folder, then its manifest."""
        folder = f"{self.root}/{key}/{uuid.uuid4().hex}"
        save(folder)
        fs, made = _file_system(self.spark, f"{folder}.json")
        out = fs.create(made, True)
        out.write(bytearray(json.dumps({"path": folder}).encode()))
        out.close()
        manifest = _file_system(self.spark, f"{self.root}/{key}/manifest.json")[1]
        if not fs.rename(made, manifest):  # another writer was first: its files are as good
            return self.find(key) or folder
        return folder

    def get(self, key: str, load: Callable[[str], object], fit: Callable[[], object], save: Callable[[object, str], None]):
        """The stored model, else a fitted one, which is stored."""
        if path := self.find(key):
            return load(path)
        model = fit()
        self.put(key, lambda folder: save(model, folder))
        return model
