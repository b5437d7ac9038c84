"""Options of the two indexes and of their scans, with bounds; unknown names are errors.

A scan option is taken from the call, else from the session (``vecskein.ivf.probes`` and so on), else from the index,
else from the default here.
"""

from __future__ import annotations

import re
import tomllib
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import SparkSession

from vecskein.session import get_option

METRICS = ("l2", "ip", "cosine")
MAX_DIM = {"ivf": 60000, "graph": 30000}


def _within(name: str, value, low, high) -> None:
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not low <= value <= high:
        raise ValueError(f"{name} must lie between {low} and {high}, not {value!r}")


def _known(kind, given: dict[str, Any], where: str) -> dict[str, Any]:
    names = {f.name for f in fields(kind)}
    if extra := sorted(set(given) - names):
        raise ValueError(f"unknown option in {where}: {', '.join(extra)}")
    return given


@dataclass
class InternalBuild:
    """Lists found by k-means: their number per level, from the root down."""

    lists: list[int] = field(default_factory=list)
    spherical_centroids: bool = False
    sampling_factor: int = 256
    kmeans_iterations: int = 10
    build_threads: int = 1
    kmeans_algorithm: str = "lloyd"
    kmeans_dimension: int | None = None

    def __post_init__(self) -> None:
        if len(self.lists) > 8:
            raise ValueError("at most 8 levels of lists")
        for n in self.lists:
            _within("lists", n, 1, 1 << 24)
        if any(a > b for a, b in zip(self.lists, self.lists[1:], strict=False)):
            raise ValueError("lists must ascend")
        _within("sampling_factor", self.sampling_factor, 1, 1024)
        _within("kmeans_iterations", self.kmeans_iterations, 0, 1024)
        _within("build_threads", self.build_threads, 1, 255)
        if isinstance(self.kmeans_algorithm, dict):  # the table form, lloyd = {}
            (self.kmeans_algorithm,) = self.kmeans_algorithm
        if self.kmeans_algorithm not in ("lloyd", "hierarchical"):
            raise ValueError("kmeans_algorithm is lloyd or hierarchical")
        if self.kmeans_dimension is not None:
            _within("kmeans_dimension", self.kmeans_dimension, 1, 16000)


@dataclass
class ExternalBuild:
    """Centroids from a table with columns id, parent, vector; its name is an identifier or schema.identifier."""

    table: str

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_$]*(\.[A-Za-z_][A-Za-z0-9_$]*)?", self.table):
            raise ValueError("external table must be written as table or schema.table")


@dataclass
class IvfOptions:
    residual_quantization: bool = False
    rerank_in_table: bool = False
    degree_of_parallelism: int = 32
    internal: InternalBuild | None = None
    external: ExternalBuild | None = None
    pin: int = -1

    def __post_init__(self) -> None:
        _within("degree_of_parallelism", self.degree_of_parallelism, 1, 256)
        self.pin = int(self.pin)
        _within("pin", self.pin, -1, 2)
        if self.internal is not None and self.external is not None:
            raise ValueError("a build is internal or external, not both")

    @classmethod
    def parse(cls, given: str | dict[str, Any] | None) -> IvfOptions:
        """From TOML or a dict: build.internal, build.external and build.pin, or flat."""
        raw = dict(tomllib.loads(given) if isinstance(given, str) else given or {})
        build = raw.pop("build", {})
        if not isinstance(build, dict) or set(build) - {"internal", "external", "pin", "default"}:
            raise ValueError("unknown option in build")
        raw |= {k: v for k, v in build.items() if k != "default"}
        if isinstance(raw.get("internal"), dict):
            raw["internal"] = InternalBuild(**_known(InternalBuild, raw["internal"], "build.internal"))
        if isinstance(raw.get("external"), dict):
            raw["external"] = ExternalBuild(**_known(ExternalBuild, raw["external"], "build.external"))
        return cls(**_known(cls, raw, "options"))

    def as_dict(self) -> dict:
        return asdict(self)


@dataclass
class GraphOptions:
    bits: int = 2
    m: int = 32
    alpha: list[float] = field(default_factory=lambda: [1.0, 1.2])
    ef_construction: int = 64
    beam_construction: int = 1

    def __post_init__(self) -> None:
        _within("bits", self.bits, 1, 2)
        _within("m", self.m, 1, 512)
        if not 1 <= len(self.alpha) <= 8 or self.alpha[0] != 1.0 or any(a > b for a, b in zip(self.alpha, self.alpha[1:], strict=False)) or not all(1.0 <= a < 2.0 for a in self.alpha):
            raise ValueError("alpha has 1 to 8 values from 1.0 up, ascending, each below 2.0")
        _within("ef_construction", self.ef_construction, 1, 65535)
        _within("beam_construction", self.beam_construction, 1, 65535)

    @classmethod
    def parse(cls, given: str | dict[str, Any] | None) -> GraphOptions:
        raw = dict(tomllib.loads(given) if isinstance(given, str) else given or {})
        raw |= raw.pop("index", {})
        return cls(**_known(cls, raw, "options"))

    def as_dict(self) -> dict:
        return asdict(self)


def _flag(x) -> bool:
    if isinstance(x, bool):
        return x
    if str(x).lower() in ("on", "true", "1", "yes"):
        return True
    if str(x).lower() in ("off", "false", "0", "no"):
        return False
    raise ValueError(f"not a switch: {x!r}")


def _probes(x) -> list[int]:
    if isinstance(x, int):
        return [x]
    return [int(v) for v in x.split(",") if v.strip()] if isinstance(x, str) else [int(v) for v in x]


#: name: (default, reading, least, most)
SCAN = {
    "ivf": {
        "enable_scan": (True, _flag, None, None),
        "probes": ([], _probes, None, None),
        "epsilon": (1.9, float, 0.0, 4.0),
        "max_scan_tuples": (-1, int, -1, 2**31 - 1),
        "maxsim_refine": (0, int, 0, 2**31 - 1),
        "maxsim_threshold": (0, int, 0, 2**31 - 1),
        "prefilter": (False, _flag, None, None),
        "io_search": ("read_stream", str, None, None),
        "io_rerank": ("read_stream", str, None, None),
    },
    "graph": {
        "enable_scan": (True, _flag, None, None),
        "ef_search": (64, int, 1, 65535),
        "beam_search": (1, int, 1, 65535),
        "max_scan_tuples": (-1, int, -1, 2**31 - 1),
        "io_search": ("read_stream", str, None, None),
        "io_rerank": ("read_stream", str, None, None),
    },
    "log": {
        "enable": (False, _flag, None, None),
        "max_records": (0, int, 0, 10000),
        "rate": (0.0, float, 0.0, 1.0),
    },
}
_IO = ("read_buffer", "prefetch_buffer", "read_stream")


def scan_options(spark: SparkSession, kind: str, given: dict[str, Any] | None = None, of_index: dict[str, Any] | None = None) -> dict[str, Any]:
    """Each option of a scan from the call, the session, the index, or the default."""
    given, of_index, out = given or {}, of_index or {}, {}
    for source in (given, of_index):
        if extra := sorted(set(source) - set(SCAN[kind])):
            raise ValueError(f"unknown scan option: {', '.join(extra)}")
    for name, (default, read, low, high) in SCAN[kind].items():
        value = given.get(name)
        if value is None:
            value = get_option(spark, f"{kind}.{name}")
        if value is None:
            value = of_index.get(name, default)
        value = read(value)
        if low is not None:
            _within(name, value, low, high)
        if name.startswith("io_") and value not in _IO:
            raise ValueError(f"{name} is one of {', '.join(_IO)}")
        out[name] = value
    return out
