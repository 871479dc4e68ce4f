"""Project and ruleset files, and where they lie."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from treeq.errors import ConfigError
from treeq.operators.rules import RuleSet

CONFIG, MARKER = ("treeq.yml", "treeq.yaml"), ".treeq"


def load_yaml(path: str | Path):
    """The content of a ``.yml`` or ``.yaml`` file; errors name the place."""
    if Path(path).suffix not in (".yml", ".yaml"):
        raise ConfigError(f"{path}: a YAML file ends in .yml or .yaml", "InvalidExtension")
    try:
        import yaml
    except ImportError:
        raise ConfigError("reading YAML needs PyYAML") from None
    try:
        return yaml.safe_load(Path(path).read_text())
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        raise ConfigError(f"{path}:{mark.line + 1}:{mark.column + 1}: {e.problem}" if mark else f"{path}: {e}") from None


@dataclass(frozen=True)
class Project:
    language: str
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()
    rulesets: tuple[str, ...] = ()
    root: str | None = None


def projects(data, root: str | None = None) -> list[Project]:
    """Projects of a configuration: one project, a list, or a list below ``projects``."""
    if isinstance(data, dict) and "projects" in data:
        return projects(data["projects"], data.get("root", root))
    if isinstance(data, dict):
        data = [data]
    try:
        return [
            Project(p["language"], tuple(p["include"]), tuple(p.get("exclude") or ()), tuple(p.get("rulesets") or ()), p.get("root", root)) for p in data or []
        ]
    except KeyError as e:
        raise ConfigError(f"a project lacks {e}") from None


def location(text: str) -> tuple[str, ...]:
    """``("git", repository, file)``, ``("registry", author, name, version)`` or ``("local", path)``."""
    if "#" in text and not text.startswith("@"):
        return ("git", *text.split("#", 1))
    if m := re.fullmatch(r"@([\w-]+)/([\w-]+)(?::([\w.-]+))?", text):
        return "registry", m[1], m[2], m[3] or "latest"
    return "local", text


def local_path(text: str, root: str | Path = ".") -> Path:
    """The file of a local location. Git and registry locations need a network."""
    kind, *rest = location(text)
    if kind != "local":
        raise ConfigError(f"{text}: {kind} locations need a network", "Network")
    return Path(root) / rest[0]


def read_ruleset(path: str | Path) -> RuleSet:
    return RuleSet.read(load_yaml(path))


def discover(start: str | Path = ".") -> Path | None:
    """The configuration beside the nearest ``MARKER`` folder upwards, or else the nearest one upwards."""
    here = Path(start).resolve()
    folders = [here, *here.parents]
    marked = [f for f in folders if (f / MARKER).is_dir()][:1]
    for folder in (*marked, *folders):
        for name in CONFIG:
            if (folder / name).is_file():
                return folder / name
    return None


@dataclass(frozen=True)
class Stem:
    """A language: the text of its specification and of the scripts with its aspects."""

    id: str
    spec: str
    aspects: tuple[str, ...] = ()


def stem(path: str | Path) -> Stem:
    """A language's YAML file ``{id, spec, aspects}``; its paths start from its folder."""
    data, folder = load_yaml(path), Path(path).parent
    try:
        return Stem(data["id"], local_path(data["spec"], folder).read_text(), tuple(local_path(a, folder).read_text() for a in data.get("aspects") or ()))
    except KeyError as e:
        raise ConfigError(f"a language lacks {e}") from None


# By language, file name endings, files that mark a project, and folders that are never part of one.
ENDINGS = {"json": (".json",), "python": (".py",), "javascript": (".js", ".mjs", ".cjs"), "yaml": (".yaml", ".yml")}
MARKERS = {"python": ("pyproject.toml", "setup.py", "setup.cfg", "requirements.txt"), "javascript": ("package.json",)}
PASSED = ("node_modules", ".venv", "venv", "__pycache__", ".git")


def detect(folder: str | Path) -> list[dict]:
    """Projects below a folder: for each language, the topmost folders with a marker, or the
    whole folder if there is none, as far as they hold files of the language."""
    top = Path(folder)
    files = [p.relative_to(top) for p in sorted(top.rglob("*")) if p.is_file() and not set(p.relative_to(top).parts[:-1]) & set(PASSED)]
    found = []
    for language, endings in ENDINGS.items():
        own = [p for p in files if p.suffix in endings and p.name not in CONFIG]
        marked = sorted({p.parent for p in files if p.name in MARKERS.get(language, ())})
        roots = [r for r in marked if not any(o != r and o in (r, *r.parents) for o in marked)] or [Path(".")]
        for root in roots:
            if any(root in (p, *p.parents) for p in own):
                made = {"language": language, "include": [f"**/*{e}" for e in endings], "exclude": [f"**/{x}/**" for x in PASSED], "rulesets": []}
                found.append(({"root": str(root)} if str(root) != "." else {}) | made)
    return found
