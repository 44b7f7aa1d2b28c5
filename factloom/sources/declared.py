"""Declared inputs: documents listed in TOML, package manifests, JSON configurations, ignore policies, archives in one file."""

from __future__ import annotations

import hashlib
import json
import re
import struct
import tomllib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("markdown", "mdx", "rustdoc", "python_docstring", "open_api", "generated_docs")
DEPENDENCY = "package string, name string, version string, path string, inherited boolean"


def declarations(spark: SparkSession, toml: str | None) -> DataFrame:
    """(path, format) of a declaration file's ``[[document]]`` rows (a small file, read by the driver); none without a file.

    A row that isn't a relative path and a known format raises, and so does a path with two formats.
    """
    rows: dict[str, str] = {}
    for d in tomllib.loads(toml or "").get("document", []):
        path, kind = d.get("path"), d.get("format", "markdown")
        if set(d) - {"path", "format"} or not isinstance(path, str) or not path or path.startswith("/") or ".." in path.split("/") or kind not in FORMATS:
            raise ValueError(f"invalid declaration: {d}")
        if rows.setdefault(path.removeprefix("./"), kind) != kind:
            raise ValueError(f"conflicting formats: {path}")
    return spark.createDataFrame(sorted(rows.items()), "path string, format string")


def discover(tree: DataFrame, declared: DataFrame, ignored: DataFrame) -> DataFrame:
    """(path, format, included, reason) of all candidates: Markdown files and declared ones.

    Each is included, or excluded with a reason: missing, hard_directory, hidden or ignore_policy. A declared format
    overrides; each path is one row. ``ignored(path)`` is what the ignore policies leave out.
    """
    from factloom.functions import paths

    t = tree.select("path", F.lit(True).alias("there"))
    found = t.where(paths.extension(F.col("path")).isin("md", "markdown")).select("path", F.lit("markdown").alias("own"))
    d = found.join(declared.withColumnRenamed("format", "said"), "path", "full_outer").join(t, "path", "left").join(ignored.select("path", F.lit(True).alias("out")).distinct(), "path", "left")
    p = F.col("path")
    reason = F.when(F.col("there").isNull(), "missing").when(paths.has_skipped_component(p), "hard_directory").when(paths.has_hidden_component(p), "hidden").when(F.col("out"), "ignore_policy")
    return d.select("path", F.coalesce("said", "own").alias("format"), reason.isNull().alias("included"), reason.alias("reason"))


def package_manifests(files: DataFrame) -> DataFrame:
    """(package, name, version, path, inherited): dependencies that the manifests ``files(path, source)`` list. Manifests that aren't TOML have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for text in b.column(0).to_pylist():
                try:
                    toml = tomllib.loads(text or "")
                except tomllib.TOMLDecodeError:
                    continue
                package = toml.get("package", {}).get("name")
                for table in ("dependencies", "dev-dependencies", "build-dependencies"):
                    for name, d in toml.get(table, {}).items():
                        d = d if isinstance(d, dict) else {"version": d}
                        out.append((package, d.get("package", name), d.get("version"), d.get("path"), d.get("workspace") is True))
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], [f.split()[0] for f in DEPENDENCY.split(", ")])

    return files.select(F.col("source").cast("string")).mapInArrow(run, DEPENDENCY)


def load_json(text: bytes, most: int = 1 << 20) -> tuple[dict, str]:
    """A JSON object and its bytes' SHA-256. Too many bytes, another value and repeated keys raise."""

    def once(pairs: list[tuple]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated key")
        return dict(pairs)

    if len(text) > most:
        raise ValueError("input over limit")
    value = json.loads(text, object_pairs_hook=once)
    if not isinstance(value, dict):
        raise ValueError("no object")
    return value, hashlib.sha256(text).hexdigest()


# Ignore policies


def _pattern(line: str, base: str) -> tuple[bool, re.Pattern] | None:
    """(revives, what it matches) of one line of a policy in directory ``base``; null for blanks and comments."""
    line = line.rstrip()
    if not line or line.startswith("#"):
        return None
    revives, line = line.startswith("!"), line.removeprefix("!")
    below, anchored, line = line.endswith("/"), "/" in line.rstrip("/"), line.strip("/")
    body = "".join({"**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.split(r"(\*\*|\*|\?)", line))
    return revives, re.compile(re.escape(base) + ("" if anchored else "(?:.*/)?") + body.replace(".*/", "(?:.*/)?") + ("/" if below else "/?") + "$")


def ignored(policies: list[tuple[str, str]]) -> object:
    """A function of a column of paths: whether the chain of ``policies`` (directory, text), outermost first, leaves them out.

    Decided from the top down: once a directory is out, nothing in it comes back. The last line that matches decides.
    """
    rules = [r for base, text in policies for line in text.split("\n") if (r := _pattern(line, base and base.rstrip("/") + "/"))]

    def one(path: str) -> bool:
        parts = path.split("/")
        for n in range(1, len(parts) + 1):
            at = "/".join(parts[:n]) + "/" * (n < len(parts))
            out = False
            for revives, pattern in rules:
                if pattern.match(at):
                    out = not revives
            if out:
                return True
        return False

    def run(s: pd.Series) -> pd.Series:
        return s.map(one, na_action="ignore").astype("boolean")

    def apply(c: Column) -> Column:
        return F.pandas_udf(run, "boolean")(c)

    return apply


# Archives in one file. Magic, version, byte order mark.
MAGIC, VERSION, ORDER = b"RPTS", 1, 0x01020304
# End of fixed values.
HEADER, ENTRY = "<4sIII", "<32sQQ"
HEADER_BYTES, ENTRY_BYTES = struct.calcsize(HEADER), struct.calcsize(ENTRY)


def write_archive(blobs: list[bytes]) -> bytes:
    """An archive's bytes: a header, an index sorted by hash, and the contents without gaps, each once."""
    unique = {hashlib.sha256(b).digest(): b for b in blobs}
    at, index, body = HEADER_BYTES + ENTRY_BYTES * len(unique), b"", b""
    for h in sorted(unique):
        index += struct.pack(ENTRY, h, at + len(body), len(unique[h]))
        body += unique[h]
    return struct.pack(HEADER, MAGIC, VERSION, ORDER, len(unique)) + index + body


def read_archives(files: DataFrame) -> DataFrame:
    """(path, sha256, content, problem) of archives ``files(path, content)``: a row for each blob, or one row that tells what is wrong.

    Checked are the header, the strict order of hashes, that contents follow each other from the index to the end, and
    each content's hash.
    """

    def check(data: bytes) -> tuple[list[tuple], str | None]:
        if len(data) < HEADER_BYTES:
            return [], "header_too_short"
        magic, version, order, n = struct.unpack_from(HEADER, data)
        if (magic, version, order) != (MAGIC, VERSION, ORDER):
            return [], "bad_magic" if magic != MAGIC else "bad_version" if version != VERSION else "bad_endian"
        at = HEADER_BYTES + n * ENTRY_BYTES
        if at > len(data):
            return [], "index_malformed"
        entries = [struct.unpack_from(ENTRY, data, HEADER_BYTES + k * ENTRY_BYTES) for k in range(n)]
        if any(a[0] >= b[0] for a, b in zip(entries, entries[1:])):  # noqa: B905
            return [], "index_not_sorted"
        out = []
        for h, start, size in entries:
            if start != at or start + size > len(data):
                return [], "not_packed"
            at = start + size
            content = data[start:at]
            if hashlib.sha256(content).digest() != h:
                return [], "hash_mismatch"
            out.append((h.hex(), content))
        return (out, None) if at == len(data) else ([], "trailing_bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, problem = check(data or b"")
                rows += [(path, h, c, None) for h, c in found] if problem is None else [(path, None, None, problem)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.string()))], ["path", "sha256", "content", "problem"])

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, "path string, sha256 string, content binary, problem string")
