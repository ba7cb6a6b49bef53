"""ZIP archives with a manifest, and configuration files."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

MANIFEST = "manifest.json"


def safe_member(name: str) -> bool:
    """A relative path without climbing, drives, backslashes or empty parts."""
    return bool(name) and not name.startswith("/") and "\\" not in name and ":" not in name and all(p not in ("", ".", "..") for p in name.rstrip("/").split("/"))


def verified_members(payload: bytes, manifest: str = MANIFEST) -> list[tuple[str, bytes]]:
    """Members of an archive whose inventory and digests equal its manifest's (name to sha256); raises otherwise."""
    with zipfile.ZipFile(io.BytesIO(payload)) as z:
        if bad := z.testzip():
            raise ValueError(f"damaged member: {bad}")
        names = [n for n in z.namelist() if not n.endswith("/")]
        if unsafe := [n for n in names if not safe_member(n)]:
            raise ValueError(f"unsafe member: {unsafe[0]}")
        if len({n.lower() for n in names}) < len(names):
            raise ValueError("members differ in case only")
        listed = json.loads(z.read(manifest))
        if set(names) - {manifest} != set(listed):
            raise ValueError("inventory differs from the manifest")
        out = [(n, z.read(n)) for n in sorted(listed)]
    if wrong := [n for n, b in out if hashlib.sha256(b).hexdigest() != listed[n]]:
        raise ValueError(f"digest differs: {wrong[0]}")
    return out


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """archive, member, sha256 and content of every verified member; an archive is read by one task, a damaged one fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, payload in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                found = verified_members(payload)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([where] * len(found)), pa.array([n for n, _ in found], pa.string()), pa.array([hashlib.sha256(b).hexdigest() for _, b in found], pa.string()), pa.array([b for _, b in found], pa.binary())],
                    ["archive", "member", "sha256", "content"],
                )

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "archive string, member string, sha256 string, content binary")


def write_archive(members: dict[str, bytes]) -> bytes:
    """A deterministic archive with its manifest: same members, same bytes."""
    out = io.BytesIO()
    listed = {n: hashlib.sha256(b).hexdigest() for n, b in members.items()}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in [*sorted(members.items()), (MANIFEST, json.dumps(listed, sort_keys=True).encode())]:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def yaml_weights(text: str, names: list[str], block: str = "evidence_type_weights") -> dict[str, float]:
    """Weights of a block of `name: number` lines in a YAML text: all names, no others, each in [0, 1]."""
    found, inside, depth = {}, False, 0
    for line in text.splitlines():
        bare = line.split("#")[0].rstrip()
        if not bare.strip():
            continue
        indent = len(bare) - len(bare.lstrip())
        key, _, value = bare.strip().partition(":")
        if inside and indent <= depth:
            break
        if inside:
            found[key.strip()] = float(value)
        elif key == block:
            inside, depth = True, indent
    if set(found) != set(names) or not all(0 <= v <= 1 for v in found.values()):
        raise ValueError("weights must name every evidence type once, in [0, 1]")
    return found
