"""Code for the workers: this package and users' projects are sent as they stand on the driver, once a session."""

from __future__ import annotations

import importlib
import importlib.util
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: dict[str, set[str]] = {}


def _zipped(name: str, folder: Path) -> str:
    to = Path(tempfile.mkdtemp(prefix="mrflow-code-")) / f"{name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(p for p in folder.rglob("*") if p.is_file() and "__pycache__" not in p.parts):
            z.write(f, f"{name}/{f.relative_to(folder).as_posix()}")
    return str(to)


def ship(spark: SparkSession, module: str = __name__.partition(".")[0]) -> None:
    """Send the package or module that ``module`` lies in to all workers, those that start later too."""
    top = module.partition(".")[0]
    sent = _SENT.setdefault(spark.sparkContext.applicationId, set())
    if top in sent:
        return
    spec = importlib.util.find_spec(top)
    if spec is None:
        raise ModuleNotFoundError(f"no module {top}", name=top)
    if spec.submodule_search_locations:
        spark.sparkContext.addPyFile(_zipped(top, Path(next(iter(spec.submodule_search_locations)))))
    elif spec.origin:
        spark.sparkContext.addPyFile(spec.origin)
    sent.add(top)
