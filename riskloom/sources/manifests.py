"""Dependency manifests and lockfiles of seven ecosystems to dependency rows.

The grammars need state (sections, nesting, continuation), so each file is parsed by one function in an Arrow-batched
pass; a file that can't be read gives an error row and no dependencies, and never fails the scan.
"""

from __future__ import annotations

import fnmatch
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.tables import ship

Row = tuple[str, str, bool, bool, str | None]  # name, version, is_dev, is_direct, parent
DEPENDENCY = "repo_id string, path string, ecosystem string, name string, version string, is_dev boolean, is_direct boolean, parent string, ord int, error string"


def _package_lock(text: str) -> Iterator[Row]:
    data = json.loads(text)
    if data.get("lockfileVersion", 1) >= 2 or "packages" in data:
        packages = data.get("packages") or {}
        root = packages.get("") or {}
        direct = {*(root.get("dependencies") or {}), *(root.get("devDependencies") or {})}
        for path, entry in packages.items():
            name = path.rpartition("node_modules/")[2]
            if not name.startswith("@"):
                name = name.partition("/")[0]
            if name and entry.get("version"):
                yield name, entry["version"], bool(entry.get("dev")), name in direct, None
        return
    todo = [(None, data.get("dependencies") or {})]
    while todo:
        parent, level = todo.pop(0)
        for name, entry in level.items():
            if entry.get("version"):
                yield name, entry["version"], bool(entry.get("dev")), parent is None, parent
            if entry.get("dependencies"):
                todo.append((name, entry["dependencies"]))


def _spec_name(spec: str) -> str:
    """``@scope/name`` or ``name`` of a spec ``name@range``."""
    spec = spec.strip().strip("\"'")
    at = spec.find("@", 1)
    return spec[:at] if at > 0 else spec


def _yarn_lock(text: str) -> Iterator[Row]:
    seen, names = set(), []
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        if not line[0].isspace():
            names = [] if line.startswith("__metadata") else [_spec_name(s) for s in line.rstrip(":").strip().strip('"').split(",")]
        elif m := re.match(r"\s+version:?\s+\"?([^\"\s]+)\"?$", line):
            for name in dict.fromkeys(names):
                if (name, m[1]) not in seen:
                    seen.add((name, m[1]))
                    yield name, m[1], False, False, None
            names = []


def _pnpm_lock(text: str) -> Iterator[Row]:
    """Keys of ``packages``, or of ``snapshots`` where there are none: ``/name@version(peers)`` or ``/name/version``."""
    found: dict[str, dict] = {"packages": {}, "snapshots": {}}
    section = None
    for line in text.splitlines():
        if m := re.match(r"(\w+):\s*$", line):
            section = m[1]
        elif section in found and (m := re.match(r"  (['\"]?)(/?[^\s:'\"][^'\"]*?)\1:\s*(?:\{.*)?$", line)):
            key = m[2].lstrip("/").partition("(")[0]
            name, _, version = key.rpartition("@") if key.find("@", 1) > 0 else key.rpartition("/")
            if name and version:
                found[section].setdefault((name, version))
    for name, version in found["packages"] or found["snapshots"]:
        yield name, version, False, False, None


_REQUIREMENT = re.compile(r"([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*(?:(?:===|==|~=|>=|<=|!=|>|<)\s*([^\s,;]+))?")


def _requirements(text: str, dev: bool = False) -> Iterator[Row]:
    for raw in text.splitlines():
        line = re.sub(r"(^|\s)#.*", "", raw).split(";")[0].strip()
        if line.startswith(("-e", "--editable")):
            if m := re.search(r"#egg=([\w.-]+)", raw):
                yield m[1].lower(), "editable", dev, True, None
        elif line and line[0] != "-" and (m := _REQUIREMENT.match(line)):
            yield m[1].lower(), m[2] or "unknown", dev, True, None


def _pipfile_lock(text: str) -> Iterator[Row]:
    data = json.loads(text)
    for section, dev in (("default", False), ("develop", True)):
        for name, entry in (data.get(section) or {}).items():
            version = entry.get("version") if isinstance(entry, dict) else entry
            if version:
                yield name, str(version).lstrip("="), dev, True, None


def _poetry_lock(text: str) -> Iterator[Row]:
    for p in tomllib.loads(text).get("package", []):
        if p.get("name") and p.get("version"):
            yield p["name"], p["version"], p.get("category") == "dev" or bool(p.get("optional")), False, None


def _go_version(v: str) -> str:
    return v.removeprefix("v").removesuffix("+incompatible")


def _go_mod(text: str) -> Iterator[Row]:
    replaced = {m[1]: (m[2], m[3]) for m in re.finditer(r"^\s*replace\s+(\S+)(?:\s+v\S+)?\s*=>\s*(\S+)\s+(v\S+)", text, re.M)}
    block = False
    for line in text.splitlines():
        s = line.strip()
        if s.startswith("require ("):
            block = True
        elif s == ")":
            block = False
        elif m := re.match(r"(?:require\s+)?([^\s(]+)\s+(v\S+)(.*)", s) if block or s.startswith("require ") else None:
            name, version = replaced.get(m[1], (m[1], m[2]))
            yield name, _go_version(version), False, "// indirect" not in m[3], None


def _go_sum(text: str) -> Iterator[Row]:
    seen = set()
    for line in text.splitlines():
        parts = line.split()
        if len(parts) >= 3:
            key = (parts[0], _go_version(parts[1].partition("/")[0]))
            if key not in seen:
                seen.add(key)
                yield *key, False, False, None


def _pom_xml(text: str) -> Iterator[Row]:
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
    values = {p.tag: (p.text or "").strip() for p in root.findall("properties/*")}
    if (v := root.findtext("version")) is not None:
        values["project.version"] = v.strip()
    fill = lambda x: re.sub(r"\$\{([^}]+)\}", lambda m: values.get(m[1], m[0]), x)
    for d in root.iter("dependency"):
        group, artifact = (d.findtext("groupId") or "").strip(), (d.findtext("artifactId") or "").strip()
        if group and artifact:
            version = fill((d.findtext("version") or "").strip()) or "managed"
            yield f"{fill(group)}:{fill(artifact)}", version, (d.findtext("scope") or "").strip() in ("test", "provided"), True, None


def _cargo_lock(text: str) -> Iterator[Row]:
    packages = tomllib.loads(text).get("package", [])
    root = next((p.get("name") for p in packages if not p.get("source")), None)
    for p in packages:
        if p.get("name") and p.get("version") and p["name"] != root:
            yield p["name"], p["version"], False, False, None


def _composer_lock(text: str) -> Iterator[Row]:
    data = json.loads(text)
    for section, dev in (("packages", False), ("packages-dev", True)):
        for p in data.get(section) or []:
            if p.get("name") and p.get("version"):
                yield p["name"], re.sub(r"^v(?=\d)", "", p["version"]), dev, False, None


def _gemfile_lock(text: str) -> Iterator[Row]:
    section, versions, direct = "", {}, set()
    for line in text.splitlines():
        s = line.strip()
        if line and not line[0].isspace():
            section = s
        elif section == "GEM" and (m := re.match(r"([\w.-]+) \(([^)]+)\)", s)):
            versions[m[1]] = m[2]  # the last one counts, nested constraints too
        elif section == "DEPENDENCIES" and (m := re.match(r"([\w.-]+)", s)):
            direct.add(m[1])
    for name, version in versions.items():
        yield name, version, False, name in direct, None


#: Ecosystem, file pattern and parser, in the order scans are listed.
FORMATS: tuple[tuple[str, str, Callable[[str], Iterator[Row]]], ...] = (
    ("npm", "package-lock.json", _package_lock), ("npm", "yarn.lock", _yarn_lock), ("npm", "pnpm-lock.yaml", _pnpm_lock),
    ("pypi", "requirements*dev*.txt", lambda t: _requirements(t, True)), ("pypi", "requirements*.txt", _requirements), ("pypi", "Pipfile.lock", _pipfile_lock), ("pypi", "poetry.lock", _poetry_lock),
    ("go", "go.mod", _go_mod), ("go", "go.sum", _go_sum), ("rubygems", "Gemfile.lock", _gemfile_lock), ("maven", "pom.xml", _pom_xml), ("cargo", "Cargo.lock", _cargo_lock), ("composer", "composer.lock", _composer_lock),
)
#: Files in the root that show an ecosystem.
INDICATORS = {
    "npm": ("package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", ".npmrc"), "pypi": ("requirements.txt", "requirements-dev.txt", "pyproject.toml", "setup.py", "setup.cfg", "Pipfile", "Pipfile.lock", "poetry.lock"), "go": ("go.mod", "go.sum"),
    "rubygems": ("Gemfile", "Gemfile.lock", ".ruby-version"), "maven": ("pom.xml", "build.gradle", "build.gradle.kts", "settings.gradle"), "cargo": ("Cargo.toml", "Cargo.lock"), "composer": ("composer.json", "composer.lock"),
}
EXCLUDED = ("node_modules", ".git", "vendor", "venv", ".venv", "__pycache__", "dist", "build")


def format_of(path: str):
    name = path.rpartition("/")[2]
    return next(((e, parse) for e, pattern, parse in FORMATS if fnmatch.fnmatch(name, pattern)), None)


def parse_manifest(path: str, text: str) -> tuple[str | None, list[Row], str | None]:
    """(ecosystem, rows, error) of one file; an unknown name has no ecosystem."""
    found = format_of(path)
    if found is None:
        return None, [], None
    try:
        return found[0], list(found[1](text)), None
    except Exception as e:  # noqa: BLE001  # whatever a broken file does to its parser is that file's error
        return found[0], [], f"{type(e).__name__}: {e}"[:200]


def scan(files: DataFrame) -> DataFrame:
    """Dependency rows of ``files`` (repo_id, path, text), see ``DEPENDENCY``; a file's error is a row without a name."""

    def run(batches):
        import pyarrow as pa

        names = [x.split()[0] for x in DEPENDENCY.split(", ")]
        kinds = [pa.string()] * 5 + [pa.bool_(), pa.bool_(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            out = []
            for repo, path, text in zip(*(batch.column(c).to_pylist() for c in ("repo_id", "path", "text")), strict=True):
                if path is None:
                    continue
                ecosystem, rows, error = parse_manifest(path, text or "")
                out += [(repo, path, ecosystem, *row, i, None) for i, row in enumerate(rows)]
                if error:
                    out.append((repo, path, ecosystem, None, None, None, None, None, None, error))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return files.select("repo_id", "path", "text").mapInArrow(run, DEPENDENCY)


def read_files(spark: SparkSession, folder: str, glob: str = "*", excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """repo_id (the folder), path below it and text of every file whose name matches and that no excluded folder holds."""
    ship(spark)
    t = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    t = t.select(F.lit(folder).alias("repo_id"), F.expr(f"substring(regexp_replace(_metadata.file_path, '^file:/+', '/'), {len(folder.rstrip('/')) + 2})").alias("path"), F.col("value").alias("text"))
    return t.filter(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))


def detect(files: DataFrame) -> DataFrame:
    """repo_id, ecosystem: an ecosystem is there if one of its files lies in the root."""
    table = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(e).alias("e")) for e, names in INDICATORS.items() for f in names))
    hit = files.filter(~F.col("path").contains("/")).select("repo_id", F.explode(F.filter(table, lambda x: x["f"] == F.col("path"))).alias("x"))
    return hit.select("repo_id", F.col("x.e").alias("ecosystem")).distinct()
