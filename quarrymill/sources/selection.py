"""Which files an ingest takes: explicit paths, a manifest, or the drop folder."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File types that can be converted, and the folder of files that are done.
SUPPORTED = (".pdf", ".docx")
PROCESSED = "processed"


@dataclass(frozen=True)
class Selection:
    """The mode that chose, the files in order, those of other types, and what went wrong."""

    mode: str
    files: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, True) for p in self.files] + [(p, False) for p in self.skipped]
        return spark.createDataFrame(rows, "path string, supported boolean")


def supported(path: Column, kinds: tuple[str, ...] = SUPPORTED) -> Column:
    """Whether the lower-cased ending is one that can be converted."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*kinds)


def supported_files(paths: DataFrame, col: str = "path", kinds: tuple[str, ...] = SUPPORTED) -> DataFrame:
    """Distinct supported paths in order."""
    return paths.where(supported(F.col(col), kinds)).select(col).distinct().orderBy(col)


def manifest_rows(explicit: DataFrame, included: DataFrame, excluded: DataFrame, col: str = "path") -> DataFrame:
    """(explicit and included paths) without the excluded ones: an exclusion also takes out an explicit path."""
    return explicit.select(col).union(included.select(col)).distinct().join(excluded.select(col).distinct(), col, "left_anti")


def _glob(root: Path, pattern: str, warnings: list[str]) -> set[Path]:
    try:
        found = root.glob(pattern) if not Path(pattern).is_absolute() else Path("/").glob(pattern.lstrip("/"))
        return {p.resolve() for p in found if p.is_file()}
    except (ValueError, NotImplementedError) as e:
        warnings.append(f"bad pattern {pattern!r}: {e}")
        return set()


def _split(paths: set[Path], mode: str, warnings: list[str]) -> Selection:
    ordered = sorted(map(str, paths))
    good = [p for p in ordered if Path(p).suffix.lower() in SUPPORTED]
    return Selection(mode, good, [p for p in ordered if p not in set(good)], warnings)


def from_paths(paths: list[str]) -> Selection:
    """Files and globs; each that finds nothing is a warning."""
    warnings: list[str] = []
    found: set[Path] = set()
    for p in paths:
        hits = _glob(Path.cwd(), p, warnings) if any(c in p for c in "*?") else {Path(p).resolve()} if Path(p).is_file() else set()
        if not hits:
            warnings.append(f"nothing found for {p!r}")
        found |= hits
    return _split(found, "paths", warnings)


def from_manifest(path: str, input_dir: str) -> Selection:
    """JSON with optional roots, include, exclude (globs under the roots) and files; excludes win over files."""
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    warnings: list[str] = []
    roots = [Path(r) for r in spec.get("roots") or [input_dir]]
    include = spec.get("include") or [f"**/*{k}" for k in SUPPORTED]
    chosen: set[Path] = set()
    for f in spec.get("files") or []:
        if Path(f).is_file():
            chosen.add(Path(f).resolve())
        else:
            warnings.append(f"no such file: {f}")
    out: set[Path] = set()
    for root in roots:
        if not root.is_dir():
            warnings.append(f"no such folder: {root}")
            continue
        for p in include:
            chosen |= _glob(root, p, warnings)
        for p in spec.get("exclude") or []:
            out |= _glob(root, p, warnings)
    return _split(chosen - out, "manifest", warnings)


def from_folder(folder: str) -> Selection:
    """Everything supported under the folder, but for what is already processed."""
    root = Path(folder).resolve()
    files = {p for p in root.rglob("*") if p.is_file() and PROCESSED not in p.relative_to(root).parts[:-1] and p.suffix.lower() in SUPPORTED} if root.is_dir() else set()
    return _split(files, "folder", [] if root.is_dir() else [f"no such folder: {folder}"])


def select_documents(paths: list[str] | None = None, manifest: str | None = None, input_dir: str = "input") -> Selection:
    """Exactly one mode: explicit paths before a manifest before the drop folder."""
    if paths:
        return from_paths(paths)
    return from_manifest(manifest, input_dir) if manifest else from_folder(input_dir)


def read_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, content, length) of the files."""
    return spark.read.format("binaryFile").load(files).select("path", "content", "length")


def scan_folder(spark: SparkSession, folder: str) -> DataFrame:
    """The drop folder read by the cluster: supported files outside of the processed part."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return every.where(supported(F.col("path")) & ~F.contains("path", F.lit(f"/{PROCESSED}/"))).select("path", "content", "length")


def move_to_processed(path: str, input_dir: str) -> str | None:
    """Moves a file of the input folder under its processed part, keeping its sub-path; _1, _2.. where the name is taken.

    Files outside of the input folder stay; the result is then None.
    """
    source, root = Path(path).resolve(), Path(input_dir).resolve()
    if not source.is_relative_to(root) or source.is_relative_to(root / PROCESSED):
        return None
    target = root / PROCESSED / source.relative_to(root)
    target.parent.mkdir(parents=True, exist_ok=True)
    n, free = 0, target
    while free.exists():
        n += 1
        free = target.with_name(f"{target.stem}_{n}{target.suffix}")
    source.rename(free)
    return str(free)
