"""Run settings: a small YAML reader for the settings' shape, defaults, a team's overlay and environment values."""
from __future__ import annotations

import pathlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame

from tessella.functions.lang import LANGUAGES
from tessella.operators.rules import CustomRule
from tessella.sources.specs import merge_config

# fixed values: defaults (every analyzer on; all languages but java)
ANALYZERS = ("imports", "consistency", "references", "tests", "patterns", "security", "hallucination", "errorhandling", "depgraph", "deadcode", "complexity", "concurrency", "resource", "migration", "docdrift", "spec")
DEFAULTS = {
    "version": 1, "block_on": "error", "languages": [n for n in LANGUAGES if n != "java"], "analyzers": dict.fromkeys(ANALYZERS, True), "watch": {"poll_interval": "500ms", "debounce": "200ms"},
    "ignore": ["vendor/", "node_modules/", "*.generated.*", "*.min.js"], "compliance": {"packs": [], "fail_on_violation": False}, "custom_rules": [],
}
UNITS = {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}


def _scalar(text: str):
    t = text.strip()
    if t[:1] in "\"'" and t[-1:] == t[:1] and len(t) > 1:
        inner = t[1:-1]
        return inner.replace("''", "'") if t[0] == "'" else inner.replace('\\"', '"').replace("\\\\", "\\")
    t = t.split(" #")[0].strip()
    if t.startswith("[") and t.endswith("]"):
        return [_scalar(x) for x in t[1:-1].split(",") if x.strip()]
    if t in ("", "~", "null"):
        return None
    if t in ("true", "false"):
        return t == "true"
    return int(t) if t.lstrip("-").isdigit() else t


def read_yaml(text: str | None):
    """Nested maps, lists and scalars by indentation; enough for settings and specifications. Broken lines are skipped."""
    rows = []
    for raw in (text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        if raw.strip() and not raw.lstrip().startswith("#") and raw.strip() != "---":
            rows.append((len(raw) - len(raw.lstrip(" ")), raw.strip()))

    def block(at: int, depth: int):
        if at < len(rows) and (rows[at][1].startswith("- ") or rows[at][1] == "-"):
            out: list = []
            while at < len(rows) and rows[at][0] == depth and (rows[at][1].startswith("- ") or rows[at][1] == "-"):
                body = rows[at][1][1:].strip()
                if ":" in body and body[:1] not in "\"'" and (body.endswith(":") or ": " in body):
                    rows[at] = (depth + 2, body)
                    value, at = block(at, depth + 2)
                else:
                    value, at = _scalar(body), at + 1
                out.append(value)
            return out, at
        result: dict = {}
        while at < len(rows) and rows[at][0] == depth and not rows[at][1].startswith("- "):
            key, sep, rest = rows[at][1].partition(":")
            at += 1
            if not sep:
                continue
            if rest.strip():
                result[_scalar(key)] = _scalar(rest)
            elif at < len(rows) and (rows[at][0] > depth or rows[at][0] == depth and rows[at][1].startswith("- ")):
                result[_scalar(key)], at = block(at, rows[at][0])
            else:
                result[_scalar(key)] = None
            while at < len(rows) and rows[at][0] > depth:  # deeper than anything open: skipped
                at += 1
        return result, at

    return block(0, rows[0][0])[0] if rows else {}


def load(text: str | None = None, team: str | None = None, environment: Mapping[str, str] | None = None) -> dict:
    """Defaults, then one's own settings, then the team's, then the environment (TESSELLA_BLOCK_ON)."""
    out = merge_config(DEFAULTS, read_yaml(text) if text else None)
    own = read_yaml(text) if text else {}
    for k in ("compliance", "custom_rules"):
        if isinstance(own, dict) and own.get(k):
            out[k] = own[k]
    if team:
        out = merge_config(out, read_yaml(team))
    if environment and environment.get("TESSELLA_BLOCK_ON"):
        out["block_on"] = environment["TESSELLA_BLOCK_ON"]
    return out


# fixed values: names of the settings' files
SETTINGS, TEAM_SETTINGS = ".tessella.yaml", ".tessella.team.yaml"


def discover(start: str, environment: Mapping[str, str] | None = None) -> dict:
    """The settings that hold in a folder: the nearest settings file there or above, the team's file beside ``start``, and
    the environment; defaults where there is none."""
    here = pathlib.Path(start).resolve()
    own = next((p for folder in (here, *here.parents) if (p := folder / SETTINGS).is_file()), None)
    team = here / TEAM_SETTINGS
    return load(own.read_text() if own else None, team.read_text() if team.is_file() else None, environment)


def seconds(duration: str) -> float:
    """A duration such as 500ms, 1.5s or 2m."""
    import re

    parts = re.findall(r"([\d.]+)(ns|us|ms|s|m|h)", duration)
    if not parts or "".join(a + b for a, b in parts) != duration:
        raise ValueError(f"not a duration: {duration!r}")
    return sum(float(a) * UNITS[b] for a, b in parts)


def validate(settings: dict) -> list[str]:
    """What is wrong with the settings; an empty list means nothing."""
    wrong = []
    if settings.get("block_on") not in ("error", "warning", "info", "none"):
        wrong.append(f"block_on: {settings.get('block_on')}")
    wrong += [f"language: {n}" for n in settings.get("languages") or [] if n not in LANGUAGES]
    for k in ("poll_interval", "debounce"):
        try:
            seconds((settings.get("watch") or {}).get(k, "1s"))
        except ValueError as e:
            wrong.append(f"watch.{k}: {e}")
    return wrong


def custom_rules(settings: dict) -> tuple[CustomRule, ...]:
    return tuple(CustomRule(r.get("id", ""), r.get("pattern", ""), r.get("files") or "", r.get("severity") or "warning", r.get("message") or "") for r in settings.get("custom_rules") or [] if isinstance(r, dict))


def enabled(settings: dict) -> frozenset[str]:
    """Names of the analyzers that are on; the users' own rules always are."""
    return frozenset(k for k, v in (settings.get("analyzers") or {}).items() if v) | {"custom"}


def settings_table(configs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, block_on, languages, analyzers_on, analyzers_off, ignored, rules): what each stored configuration sets. Null texts set nothing."""
    kind = configs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text]):
                s = read_yaml(t)
                s = s if isinstance(s, dict) else {}
                a = s.get("analyzers") or {}
                rows.append((k, s.get("block_on"), len(s.get("languages") or []), sum(v is True for v in a.values()), sum(v is False for v in a.values()), len(s.get("ignore") or []), len(s.get("custom_rules") or [])))
            yield pd.DataFrame(rows, columns=[key, "block_on", "languages", "analyzers_on", "analyzers_off", "ignored", "rules"])

    return configs.select(key, text).mapInPandas(run, f"`{key}` {kind}, block_on string, languages long, analyzers_on long, analyzers_off long, ignored long, rules long")
