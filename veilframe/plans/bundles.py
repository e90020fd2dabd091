"""Policy bundles: JSON to checked, typed plans."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from .conditions import ConditionError, Leaf, Node, parse

#: Enforcement, least to most restrictive; and side effects.
ENFORCEMENT = ("allow", "audit", "warn", "justify", "request_approval", "encrypt", "quarantine", "block")
EFFECTS = ("notify_user", "notify_admin", "create_incident", "tag")
_POLICY_KEYS = {"id", "name", "priority", "mode", "enabled", "scope", "channels", "schedule", "rules"}
_SCOPE_KEYS = ("users", "groups", "exclude_users", "exclude_groups")


class BundleError(ValueError):
    """A bundle that can't be used."""


@dataclass(frozen=True)
class Effect:
    action: str
    params: str  # JSON


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    exception: bool
    when: Leaf | Node
    enforcement: int | None  # place in ENFORCEMENT
    effects: tuple[Effect, ...]


@dataclass(frozen=True)
class Policy:
    id: str
    name: str
    priority: int
    monitor: bool
    enabled: bool
    scope: dict[str, tuple[str, ...]]
    channels: tuple[str, ...]
    activate_at: datetime | None
    expire_at: datetime | None
    rules: tuple[Rule, ...]


@dataclass(frozen=True)
class Bundle:
    tenant_id: str
    version: str
    labels: tuple[str, ...]
    default: str
    policies: tuple[Policy, ...]


def timestamp(text: str | None, where: str) -> datetime | None:
    if text is None:
        return None
    try:
        at = datetime.fromisoformat(text)
    except ValueError as e:
        raise BundleError(f"{where}: {text} is no RFC 3339 time") from e
    if at.tzinfo is None:
        raise BundleError(f"{where}: {text} has no offset")
    return at.astimezone(UTC)


def _known(d: dict, keys: set[str], where: str) -> None:
    if odd := sorted(set(d) - keys):
        raise BundleError(f"{where}: unknown field {odd[0]}")


def _rule(d: dict, lists: dict, where: str) -> Rule:
    _known(d, {"id", "name", "exception", "when", "then"}, where)
    where = f"{where}/{d['id']}"
    try:
        when = parse(d["when"], lists)
    except ConditionError as e:
        raise BundleError(f"{where}: {e}") from e
    enforced, effects = [], []
    for a in d.get("then", []):
        kind = a.get("action")
        if kind in ENFORCEMENT:
            enforced.append(ENFORCEMENT.index(kind))
        elif kind in EFFECTS:
            effects.append(Effect(kind, json.dumps({k: v for k, v in a.items() if k != "action"}, sort_keys=True, ensure_ascii=False)))
        else:
            raise BundleError(f"{where}: unknown action {kind}")
    exception = bool(d.get("exception", False))
    if not d.get("then"):
        raise BundleError(f"{where}: a rule needs an action")
    if len(enforced) > 1:
        raise BundleError(f"{where}: a rule takes one enforcement action at most")
    if exception and enforced not in ([], [0]):
        raise BundleError(f"{where}: an exception can only allow")
    return Rule(d["id"], d.get("name", ""), exception, when, 0 if exception else (enforced or [None])[0], tuple(effects))


def _policy(d: dict, lists: dict) -> Policy:
    where = d.get("id", "?")
    _known(d, _POLICY_KEYS, where)
    if d.get("mode", "enforce") not in ("enforce", "monitor"):
        raise BundleError(f"{where}: unknown mode {d['mode']}")
    scope, schedule = d.get("scope") or {}, d.get("schedule") or {}
    _known(scope, set(_SCOPE_KEYS), where)
    _known(schedule, {"activate_at", "expire_at"}, where)
    rules = tuple(_rule(r, lists, where) for r in d.get("rules", []))
    if len({r.id for r in rules}) < len(rules):
        raise BundleError(f"{where}: a rule id comes twice")
    return Policy(d["id"], d.get("name", ""), int(d.get("priority", 0)), d.get("mode") == "monitor", d.get("enabled", True), {k: tuple(x.lower() for x in scope.get(k, [])) for k in _SCOPE_KEYS}, tuple(d.get("channels", [])), timestamp(schedule.get("activate_at"), where), timestamp(schedule.get("expire_at"), where), rules)


def load_bundle(doc: str | dict[str, Any]) -> Bundle:
    doc = json.loads(doc) if isinstance(doc, str) else doc
    _known(doc, {"schema_version", "tenant_id", "bundle_version", "classifications", "lists", "default_action", "policies"}, "bundle")
    if not str(doc.get("schema_version", "")).startswith("1."):
        raise BundleError(f"schema version {doc.get('schema_version')} is not 1.x")
    labels = [x.lower() for x in doc.get("classifications", [])]
    if not labels or len(set(labels)) < len(labels):
        raise BundleError("classifications must be there, each once")
    default = doc.get("default_action", "allow")
    if default not in ENFORCEMENT:
        raise BundleError(f"unknown default action {default}")
    policies = tuple(_policy(p, doc.get("lists") or {}) for p in doc.get("policies", []))
    if len({p.id for p in policies}) < len(policies):
        raise BundleError("a policy id comes twice")
    return Bundle(doc["tenant_id"], doc["bundle_version"], tuple(labels), default, policies)
