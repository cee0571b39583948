"""Command line: ``python -m boscage.cli [--json CHAIN | --to-json] [FLAGS] SOURCE STEP...``, or ``init`` to see what is there."""

from __future__ import annotations

import dataclasses
import importlib.metadata
import json
import os
import shutil
import sys
import tomllib

from .plans.chain import Chain, ChainError
from .selection import Grove


@dataclasses.dataclass
class Config:
    """The table ``[tool.boscage]`` of a folder's pyproject.toml."""

    plugins: tuple[str, ...] = ()
    #: Short names of sources.
    sources: dict[str, str | list[str]] = dataclasses.field(default_factory=dict)
    repo: str | None = None
    #: Whether trees are kept, and in which folder.
    cache: bool = False
    cache_path: str = ".boscage"

    @classmethod
    def load(cls, folder: str = ".") -> Config:
        path = os.path.join(folder, "pyproject.toml")
        if not os.path.exists(path):
            return cls()
        with open(path, "rb") as f:
            said = tomllib.load(f).get("tool", {}).get("boscage", {})
        known = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: tuple(v) if k == "plugins" else v for k, v in said.items() if k in known})

    def source(self, name: str) -> list[str]:
        found = self.sources.get(name, name)
        return [found] if isinstance(found, str) else list(found)


def config(folder: str = ".") -> Config:
    return Config.load(folder)


def chain_from(argv: list[str], known: Config | None = None) -> Chain:
    known = known or Config()
    if argv[:1] == ["--json"]:
        if len(argv) < 2:
            raise ChainError("--json needs a chain")
        chain = Chain.from_json(sys.stdin.read() if argv[1] == "-" else argv[1])
    else:
        chain = Chain.from_argv([*(f"--plugin={p}" for p in known.plugins), *argv])
    sources = tuple(x for s in chain.source for x in known.source(s))
    return dataclasses.replace(chain, source=sources, repo=chain.repo or known.repo)


def init() -> dict[str, str]:
    """What is there to run with; nothing needs to be installed."""
    found = {"python": sys.version.split()[0]}
    for name in ("pyspark", "pyarrow", "pandas"):
        found[name] = importlib.metadata.version(name)
    found["git"] = shutil.which("git") or "missing: history, at, diff and blame won't work"
    return found


def printed(result: dict) -> str:
    data = result["data"]
    if isinstance(data, str):
        return data
    if isinstance(data, list) and all(isinstance(x, (str, int)) for x in data):
        return "\n".join(map(str, data))
    return json.dumps(data, indent=1, ensure_ascii=False)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if not argv or argv[0] in ("-h", "--help"):
        print(__doc__)
        return 0
    if argv == ["init"]:
        print("\n".join(f"{k}: {v}" for k, v in init().items()))
        return 0
    as_json = "--to-json" in argv
    try:
        known = config()
        chain = chain_from([a for a in argv if a != "--to-json"], known)
        if as_json:
            print(chain.to_json(indent=1))
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("boscage").getOrCreate()
        grove = Grove(spark, list(chain.source), repo=chain.repo, plugins=chain.plugins, cache=known.cache_path if known.cache else None)
        print(printed(chain.evaluate(spark, grove)))
        return 0
    except (ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
