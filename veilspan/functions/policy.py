"""Policies: reading, merging and fingerprints on the driver, and tightening of tables of policies.

A policy is a tree of dicts. Merging walks it as a flat table from paths to leaves, and what happens
where both sides have a leaf is a rule of that path; so all merges share one function.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Mapping
from copy import deepcopy
from numbers import Real
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default policy.
DEFAULT_POLICY = {
    "service": {"url": "http://127.0.0.1:7411", "timeout_ms": 4000, "fail_open": False},
    "placeholders": {"open": "[[", "close": "]]", "format_preserving": False},
    "deny_paths": ["~/.ssh/**", "**/.env*", "**/*.pem", "**/*.key", "**/*.p12", "~/.aws/credentials", "~/.kube/config", "~/.netrc", "**/*.ovpn", "**/*.tfstate"],
    "detectors": {
        "gliner": {
            "labels": [
                "person", "email", "phone_number", "address", "organization", "government_id", "password", "secret", "api_key", "access_token", "ip_address",
                "bank_account", "iban", "payment_card", "date_of_birth", "internal hostname", "project codename",
            ],
            "threshold": 0.5,
        },
        "llm": {"enabled": False},
    },
    "custom": {"patterns": [], "literals": []},
    "allow": ["127.0.0.1", "example.com"],
    "org": {"policy_url": None, "token": None, "audit_url": None},
}

Rule = Callable[[Any, Any], Any]
ABSENT = object()


def flat(policy: Mapping) -> dict[tuple, Any]:
    """Leaves by path; an empty dict is a leaf."""
    out, todo = {}, [((), policy)]
    while todo:
        path, node = todo.pop()
        if isinstance(node, Mapping) and node:
            todo += [((*path, key), node[key]) for key in reversed(node)]
        elif path:
            out[path] = node
    return out


def tree(leaves: Mapping[tuple, Any]) -> dict:
    """The policy of a table of leaves."""
    out: dict = {}
    for path, leaf in leaves.items():
        at = out
        for key in path[:-1]:
            at = at.setdefault(key, {})
        at[path[-1]] = deepcopy(leaf)
    return out


def combined(base: Mapping, over: Mapping, rule: Callable[[tuple], Rule | None]) -> dict:
    """``base`` with the leaves of ``over`` put in by the rule of their path; a path without a rule keeps
    base's leaf. A rule gets ABSENT where base has none, and leaves it so by returning ABSENT."""
    leaves = flat(base)
    for path, new in flat(over).items():
        how = rule(path)
        if how is None:
            continue
        value = how(leaves.get(path, ABSENT), new)
        if value is not ABSENT:
            below = [p for p in leaves if p[: len(path)] == path or path[: len(p)] == p]
            if isinstance(value, Mapping) and any(len(p) > len(path) for p in below):
                continue  # an empty dict over a full one adds nothing
            for p in below:
                if p != path:
                    del leaves[p]
            leaves[path] = value
    return tree(leaves)


def _replace(old: Any, new: Any) -> Any:
    return old + new if isinstance(old, list) and isinstance(new, list) else new


def merge_personal(base: dict, over: dict) -> dict:
    """Dicts by key, lists one after the other (repeats stay), other values replaced."""
    return combined(base, over, lambda path: _replace)


def _listed(old: Any) -> list:
    return old if isinstance(old, list) else []


def _add_new(old: Any, new: Any) -> Any:
    """A list grows by what it doesn't have yet."""
    return [*_listed(old), *dict.fromkeys(x for x in new if x not in _listed(old))] if isinstance(new, list) else ABSENT


def _append(old: Any, new: Any) -> Any:
    return [*_listed(old), *new] if isinstance(new, list) else ABSENT


def _both(old: Any, new: Any) -> Any:
    return sorted(set(_listed(old)) & set(new)) if isinstance(new, list) else ABSENT


def _number(value: Any) -> bool:
    return isinstance(value, Real) and not isinstance(value, bool)


def _lower(old: Any, new: Any) -> Any:
    return min(old, new) if _number(old) and _number(new) else ABSENT


# What a local policy may change of a central one.
TIGHTENING: dict[tuple, Rule] = {
    ("deny_paths",): _add_new, ("custom", "patterns"): _append, ("custom", "literals"): _append, ("detectors", "gliner", "labels"): _add_new,
    ("allow",): _both, ("detectors", "gliner", "threshold"): _lower, ("detectors", "entropy", "threshold"): _lower,
}


def tighten(central: dict, local: dict) -> dict:
    """A local policy may only tighten a central one: deny-lists, custom rules and a model's labels grow,
    the allow-list is intersected, thresholds only sink and only where the central policy has them,
    nothing fails open. Values of a wrong type change nothing."""
    out = combined(central, local, TIGHTENING.get)
    return merge_personal(out, {"service": {"fail_open": False}})


def tightened(central: Column, local: Column) -> Column:
    """As tighten(), for tables of policies: structs of deny, literals, labels and allow (array<string>), entropy and
    threshold (double), of which any may be null where a policy lacks them."""
    none = F.array().cast("array<string>")
    have = lambda p, name: F.coalesce(p[name], none)
    grown = lambda name: F.concat(have(central, name), F.array_except(have(local, name), have(central, name)))
    lower = lambda name: F.when(central[name].isNotNull(), F.least(central[name], local[name]))
    common = F.array_sort(F.array_intersect(have(central, "allow"), local["allow"]))
    return F.struct(
        grown("deny").alias("deny"), F.concat(have(central, "literals"), have(local, "literals")).alias("literals"), grown("labels").alias("labels"),
        F.when(local["allow"].isNull(), have(central, "allow")).otherwise(common).alias("allow"), lower("entropy").alias("entropy"), lower("threshold").alias("threshold"),
        F.lit(False).alias("fail_open"),
    )


# Leaves that a layer may set, with their types; other leaves and types are passed over.
LAYER_TYPES: dict[tuple, type] = {
    ("service", "url"): str, ("service", "timeout_ms"): Real, ("placeholders", "format_preserving"): bool, ("org", "policy_url"): str,
    ("org", "token"): str, ("org", "audit_url"): str, ("org", "public_key"): str,
}
LAYER_LISTS = (("deny_paths",), ("allow",))
# Leaves that the environment may set, by the names' ends.
ENVIRONMENT = {"URL": ("service", "url"), "TOKEN": ("org", "token"), "POLICY_URL": ("org", "policy_url"), "AUDIT_URL": ("org", "audit_url"), "PUBLIC_KEY": ("org", "public_key")}


def project_lists(layer: dict | None) -> dict:
    """The deny- and allow-list of a project's layer, its strings alone; that is all that a project may add."""
    own = flat(layer or {})
    return {path[0]: [x for x in own[path] if isinstance(x, str)] for path in LAYER_LISTS if isinstance(own.get(path), list)}


def add_layer(config: dict, layer: dict | None) -> dict:
    """A client's config with a layer's typed leaves put over it and its lists' new strings added."""

    def rule(path: tuple) -> Rule | None:
        kind = LAYER_TYPES.get(path)
        fits = lambda new: _number(new) if kind is Real else isinstance(new, kind)
        return None if kind is None else lambda old, new: new if fits(new) else ABSENT

    return combined(combined(config, layer or {}, rule), project_lists(layer), {p: _add_new for p in LAYER_LISTS}.get)


def add_environment(config: dict, prefix: str = "VEILSPAN_", environment: Mapping[str, str] | None = None) -> dict:
    """A client's config with what the environment sets; empty values set nothing."""
    named = os.environ if environment is None else environment
    for end, path in ENVIRONMENT.items():
        if value := named.get(prefix + end):
            config = merge_personal(config, tree({path: value}))
    return config


def client_config(layers: list[dict | None], project: dict | None = None, environment: Mapping[str, str] | None = None) -> dict:
    """The first layer that there is over the default, then the environment, then the project's lists."""
    first = next((x for x in layers if x is not None), None)
    config = add_environment(add_layer(DEFAULT_POLICY, first), environment=environment)
    return add_layer(config, project_lists(project))


def read_policy(path: str | Path) -> dict | None:
    """A YAML or JSON policy: None if the file is missing or can't be read, an empty dict if it is empty."""
    try:
        text = Path(path).read_text()
    except OSError:
        return None
    try:
        return json.loads(text) if text.strip() else {}
    except ValueError:
        pass
    try:
        import yaml
    except ModuleNotFoundError:
        return None
    try:
        return yaml.safe_load(text) or {}
    except yaml.YAMLError:
        return None


def read_signed(folder: str | Path, date: str, verify: Callable[[bytes, str, str], bool] | None = None) -> dict | None:
    """(policy, policy_version, signature, key_id) of a folder with policy.json, policy.sig and, if not
    ``default``, key_id; None where a file is missing, can't be read or, with ``verify``, isn't
    genuine. Without ``verify`` (bytes, signature, key id) the signature is passed on unchecked."""
    at = Path(folder)
    try:
        blob, signature = (at / "policy.json").read_bytes(), (at / "policy.sig").read_text().strip()
        key = (at / "key_id").read_text().strip() if (at / "key_id").is_file() else "default"
        policy = load_policy(json.loads(blob), None)
    except (OSError, ValueError, AttributeError):
        return None
    if verify is not None and not verify(blob, signature, key):
        return None
    return {"policy": policy, "policy_version": f"{date}.{hashlib.sha256(blob).hexdigest()[:16]}", "signature": signature, "key_id": key}


def load_policy(central: dict | None, personal: dict | None, project: dict | None = None) -> dict:
    """Central mode takes the central policy as it is, which the personal and the project's policies may only
    tighten; no default is added to it. Else these two go over the default, one after the other."""
    layers = [x for x in (personal, project) if x]
    if central is not None:
        out = merge_personal(central, {"service": {"fail_open": False}})
        for layer in layers:
            out = tighten(out, layer)
        return out
    out = deepcopy(DEFAULT_POLICY)
    for layer in layers:
        out = merge_personal(out, layer)
    return out


def canonical(policy: dict) -> str:
    return json.dumps(policy, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(policy: dict) -> str:
    return hashlib.sha256(canonical(policy).encode()).hexdigest()[:16]


def version(policy: dict, date: str) -> str:
    return f"{date}.{fingerprint(policy)}"
