"""Settings of model endpoints: a profile of a YAML or JSON file, with overrides from the environment."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Endpoint:
    model: str
    base_url: str
    api_key: str = ""
    timeout_sec: int = 180
    transport_retries: int = 2
    retry_delay_sec: int = 2
    fallback: Endpoint | None = None


@dataclass(frozen=True)
class Profile:
    llm: Endpoint
    embed: Endpoint


def _mapping(value, name: str) -> dict:
    if not isinstance(value, dict):
        raise ValueError(f"{name} must be a mapping")
    return value


def _whole(value, default: int) -> int:
    return default if value in (None, "") else int(value)


def endpoint(section: dict, name: str) -> Endpoint:
    text = lambda k: "" if section.get(k) is None else str(section[k]).strip()
    for k in ("model", "base_url"):
        if not text(k):
            raise ValueError(f"{name}.{k} is missing")
    spare = section.get("fallback")
    return Endpoint(text("model"), text("base_url").rstrip("/"), text("api_key"), _whole(section.get("timeout_sec"), 180), _whole(section.get("transport_retries"), 2), _whole(section.get("retry_delay_sec"), 2), endpoint(_mapping(spare, f"{name}.fallback"), f"{name}.fallback") if spare else None)


def parse(text: str) -> dict:
    try:
        return _mapping(json.loads(text), "the file")
    except ValueError:
        import yaml

        return _mapping(yaml.safe_load(text), "the file")


def load_profile(path: str | None = None, profile: str | None = None, env: dict[str, str] | None = None) -> Profile:
    """path and profile: arguments, else FABULA_CONFIG and FABULA_PROFILE, else "default"; FABULA_LLM_MODEL and the like override fields."""
    env = os.environ if env is None else env
    path = path or env.get("FABULA_CONFIG")
    if not path:
        raise ValueError("no configuration file is named")
    with open(path, encoding="utf-8") as f:
        profiles = _mapping(parse(f.read()).get("profiles"), "profiles")
    name = profile or env.get("FABULA_PROFILE") or "default"
    if name not in profiles:
        raise KeyError(name)
    found = {}
    for kind in ("llm", "embed"):
        e = endpoint(_mapping(_mapping(profiles[name], name).get(kind), f"{name}.{kind}"), f"{name}.{kind}")
        changed = {k: v for k in ("model", "base_url", "api_key") if (v := env.get(f"FABULA_{kind.upper()}_{k.upper()}"))}
        found[kind] = replace(e, **changed)
    return Profile(**found)
