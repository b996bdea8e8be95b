"""Where a collection comes from: the digest of its input, the code, the machine and the producer."""

from __future__ import annotations

import hashlib
import os
import platform
import subprocess
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOP = Path(__file__).resolve().parents[1]
# The parts of a producer's identity that are looked for in its descriptor.
SOURCE_KEYS = ("schema", "producer", "producer_version", "run_id", "git_tree_sha1", "git_dirty", "config_hash", "seed", "created", "identity")


def series_digest(df: DataFrame) -> str:
    """A digest of a series' rows, whatever the order and files they are read from.

    Two sums of 64-bit hashes over row, time and value, and the number of rows:
    another value, time or place in any row gives another digest.
    """
    cols = ["row", "t", F.coalesce(F.col("x").cast("string"), F.lit(""))]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")).cast("string")
    return hashlib.sha256(repr(tuple(df.agg(F.count("*"), total(1), total(2)).first())).encode()).hexdigest()


def file_sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    return digest.hexdigest()


def tree_hash(folder: str | Path) -> str:
    """The id that git gives the tree of a folder's files; hidden files and caches are left out."""
    rows = []
    for p in Path(folder).iterdir():
        if p.name.startswith(".") or p.name == "__pycache__":
            continue
        if p.is_symlink():
            mode, kind, data = "120000", "blob", os.readlink(p).encode()
        elif p.is_dir():
            inner = tree_hash(p)
            if inner == EMPTY_TREE:
                continue
            rows.append((p.name + "/", b"40000 " + p.name.encode() + b"\0" + bytes.fromhex(inner)))
            continue
        else:
            mode, kind, data = "100755" if os.access(p, os.X_OK) else "100644", "blob", p.read_bytes()
        blob = hashlib.sha1(f"{kind} {len(data)}\0".encode() + data).digest()
        rows.append((p.name, f"{mode} {p.name}\0".encode() + blob))
    body = b"".join(r for _, r in sorted(rows, key=lambda x: x[0].encode()))
    return hashlib.sha1(f"tree {len(body)}\0".encode() + body).hexdigest()


#: What git calls a tree without files.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"


def git_state(folder: str | Path = TOP) -> dict:
    """Commit and whether files differ from it; empty outside a repository."""

    def git(*args):
        done = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True, timeout=10, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    try:
        commit = git("rev-parse", "HEAD")
        return {} if commit is None else {"commit": commit, "dirty": bool(git("status", "--porcelain"))}
    except (OSError, subprocess.TimeoutExpired):
        return {}


def code_identity() -> dict:
    return {"tree": tree_hash(TOP), "git": git_state()}


def environment(spark: SparkSession) -> dict:
    """The driver's machine and the session's shape."""
    context = spark.sparkContext
    return {"host": platform.node(), "machine": platform.machine(), "system": platform.platform(), "cpus": os.cpu_count(), "python": platform.python_version(), "spark": spark.version, "master": context.master, "parallelism": context.defaultParallelism}


def source_summary(descriptor: dict) -> dict:
    """A producer's identity in one shape, from the keys that descriptors use; what is unknown is None or empty."""
    tables = [descriptor, *(descriptor[k] for k in ("producer", "code", "session", "run") if isinstance(descriptor.get(k), dict))]
    find = lambda *names: next((t[n] for t in tables for n in names if n in t and not isinstance(t[n], dict)), None)
    tree = find("git_tree_sha1", "tree")
    values = {"schema": find("schema"), "producer": find("producer", "name"), "producer_version": find("producer_version", "version"), "run_id": find("run_id", "id"), "git_tree_sha1": tree, "git_dirty": find("git_dirty", "dirty"), "config_hash": find("config_hash"), "seed": find("seed"), "created": find("created"), "identity": bool(tree)}
    return {k: values[k] for k in SOURCE_KEYS}


def source_record(path: str) -> dict:
    """A source descriptor, any TOML file, with its checksum and summary."""
    with open(path, "rb") as f:
        descriptor = tomllib.load(f)
    return {"sha256": file_sha256(path), "descriptor": descriptor, "summary": source_summary(descriptor)}


def dataset_descriptor(folder: str, name: str) -> dict | None:
    """``<folder>/datasets/<name>.toml``; None without a name."""
    if not name:
        return None
    path = Path(folder) / "datasets" / f"{name}.toml"
    if not path.is_file():
        raise ValueError(f"no dataset descriptor {path}")
    return tomllib.loads(path.read_text())


def verify_checksum(descriptor: dict | None, path: str) -> None:
    """Raise if the descriptor states another SHA-256 than the input file has."""
    stated = (descriptor or {}).get("sha256")
    if stated:
        found = file_sha256(path.removeprefix("file://"))
        if found != stated:
            raise ValueError(f"the input has the checksum {found}, its descriptor says {stated}")
