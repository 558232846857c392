"""Source packs: YAML documents that declare a source's discovery, extraction and contract. Small, read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from provenant.functions import markup
from provenant.functions.scalars import check_chain
from provenant.operators import registry
from provenant.operators.contract import Contract, Field

# Sites that no pack may name, and keys that hold secrets.
DENIED = frozenset({"amazon", "linkedin", "instagram", "facebook", "ticketmaster", "eventim", "stubhub"})
SECRET = re.compile(r"authorization|auth(?![a-zA-Z])|login|password|cookie|session|credential|bearer|api_key", re.IGNORECASE)

# What a pack must answer before its source is read, and the terms that allow it.
ANSWERS = ("tos_url", "tos_verdict", "tos_reviewed_at", "reviewed_by", "robots_checked_at", "public_content", "personal_data")
VERDICTS = ("permits", "silent")


class PackError(ValueError):
    """A pack that can't be used, and why."""


@dataclass(frozen=True)
class Pack:
    domain: str
    entity: str
    version: int
    contract: Contract
    sources: tuple[dict[str, Any], ...]
    derived: dict[str, tuple[tuple[str, ...], str]] = field(default_factory=dict)
    discovery: dict[str, Any] = field(default_factory=dict)

    def transforms(self) -> dict[str, list[str]]:
        """The transforms of each extracted field, by the first source that has it."""
        out: dict[str, list[str]] = {}
        for source in self.sources:
            for name, what in source.get("fields", {}).items():
                chain = what.get("transform", []) if isinstance(what, dict) else []
                out.setdefault(name, list(chain or source.get("transforms", {}).get(name, [])))
        return out


def _secrets(value: Any, where: str = "") -> list[str]:
    if isinstance(value, dict):
        return [f"credential:{where}{k}" for k in value if SECRET.search(str(k))] + [x for k, v in value.items() for x in _secrets(v, f"{where}{k}.")]
    return [x for v in value for x in _secrets(v, where)] if isinstance(value, list) else []


def _compliance(answers: Any) -> list[str]:
    """What is wrong with a pack's answers on terms, robots and personal data; a pack without them is not admitted."""
    if not isinstance(answers, dict):
        return ["compliance"]
    wrong = [f"compliance:{name}" for name in ANSWERS if answers.get(name) in (None, "")]
    if answers.get("tos_verdict") not in VERDICTS and "compliance:tos_verdict" not in wrong:
        wrong.append("compliance:tos_verdict")
    if answers.get("personal_data") and not str(answers.get("legal_basis") or "").strip():
        wrong.append("compliance:legal_basis")
    return wrong


def _labels(domain: str) -> list[str]:
    """The labels of a domain as DNS has them; one that has no such form is taken as it is."""
    out = []
    for label in domain.lower().split("."):
        try:
            out.append(label.encode("idna").decode())
        except UnicodeError:
            out.append(label)
    return out


def _selectors(source: dict[str, Any]) -> list[str]:
    """Selectors of a css source that can't be read."""
    wrong = []
    what = {n: w if isinstance(w, str) else w.get("selector", "") for n, w in source.get("fields", {}).items()} | ({"row_selector": source["row_selector"]} if source.get("row_selector") else {})
    for name, selector in what.items():
        try:
            markup.Automaton([selector.partition("@")[0]])
        except ValueError:
            wrong.append(f"{name}:selector")
    return wrong


#: The least fill rate that a required field may be content with.
LEAST_FILL = 0.5


def _contract(document: dict[str, Any], fields: dict[str, Any]) -> list[str]:
    """Fields that nothing gives, keys that may be empty, and required fields that may mostly be.

    A source that is no css source may give any field.
    """
    given = css_fields(document)
    open_ended = any(s.get("kind") != "css" for s in document.get("extract", {}).get("sources", []))
    wrong = [f"unsourced:{name}" for name, f in fields.items() if not (open_ended or name in given or f.get("derived_from"))]
    wrong += [f"natural_key_optional:{k}" for k in document.get("schema", {}).get("natural_key", []) if k in fields and not fields[k].get("required")]
    return wrong + [f"min_fill_rate:{name}" for name, f in fields.items() if f.get("required") and f.get("min_fill_rate") is not None and f["min_fill_rate"] < LEAST_FILL]


def css_fields(document: dict[str, Any]) -> set[str]:
    """Names of all fields that any css source of a pack document has."""
    return {name for s in document.get("extract", {}).get("sources", []) if s.get("kind") == "css" for name in s.get("fields", {})}


def check(document: dict[str, Any]) -> list[str]:
    """What is wrong with a pack document, all of it."""
    wrong = _secrets(document) + _compliance(document.get("compliance"))
    if "respect_robots" in document.get("fetch", {}):
        wrong.append("fetch:respect_robots")  # robots can't be switched off
    wrong += [f"denied:{x}" for x in _labels(str(document.get("domain", ""))) if x in DENIED]
    found = document.get("discovery", {})
    needs = {"sitemap": ["sitemap_url"], "pagination": ["url_template"], "seed_list": ["seeds"]}.get(found.get("strategy"), [])
    wrong += [f"discovery_needs:{n}" for n in needs if not found.get(n)]
    if found.get("strategy") == "pagination" and "{n}" not in str(found.get("url_template", "")):
        wrong.append("discovery_needs:{n}")
    try:
        re.compile(found.get("url_pattern") or "")
    except re.error:
        wrong.append("url_pattern")
    for source in document.get("extract", {}).get("sources", []):
        if not registry.known(source.get("kind")) and source.get("kind") not in registry.STUBS:
            wrong.append(f"source:{source.get('kind')}")
        if source.get("kind") == "xhr" and str(source.get("method", "GET")).upper() != "GET":
            wrong.append("xhr:method")
        if source.get("kind") == "css":
            wrong += _selectors(source)
        if source.get("kind") == "embedded_json" and bool(source.get("script_id")) == bool(source.get("var_name")):
            wrong.append("embedded_json:script_id_or_var_name")
        for name, what in source.get("fields", {}).items():
            wrong += [f"{name}:{x}" for x in check_chain(what.get("transform", []))] if isinstance(what, dict) else []
        for name, chain in source.get("transforms", {}).items():
            wrong += [f"{name}:{x}" for x in check_chain(chain)]
    declared = document.get("schema", {})
    names = set(declared.get("fields", {}))
    wrong += [f"natural_key:{k}" for k in declared.get("natural_key", []) if k not in names]
    wrong += _contract(document, declared.get("fields", {}))
    wrong += ["natural_key"] * (not declared.get("natural_key"))
    return wrong


def pack(document: dict[str, Any]) -> Pack:
    """A pack from its document; anything wrong with it is an error."""
    if wrong := check(document):
        raise PackError("; ".join(wrong))
    schema, quality = document["schema"], document.get("quality", {})
    fields = []
    for name, f in schema["fields"].items():
        low, high = f.get("sane_range") or (None, None)
        fields.append(Field(name, f["type"], f.get("required", False), f.get("min_fill_rate"), low, high, tuple(f["enum"]) if f.get("enum") else None, f.get("pattern")))
    contract = Contract(
        tuple(fields), tuple(schema["natural_key"]),
        quality.get("min_rows_per_run", 1), quality.get("row_count_deviation", 0.30), quality.get("max_duplicate_rate", 0.02), quality.get("max_range_violation_rate", 0.05),
        document.get("healing", {}).get("max_auto_versions_per_window", 3),
    )
    derived = {}
    for name, f in schema["fields"].items():
        if d := f.get("derived_from"):
            parts = d.get("sources") or [d["source"]]
            derived[name] = (tuple(parts), d["transform"])
    return Pack(document["domain"], document["entity"], document.get("version", 1), contract, tuple(document.get("extract", {}).get("sources", [])), derived, document.get("discovery", {}))


def load(root: str | Path) -> list[Pack]:
    """All packs below a folder, by path <domain>/<entity>.yaml; names must agree with the path, and none may come twice."""
    import yaml

    out: dict[tuple[str, str], Pack] = {}
    for path in sorted(Path(root).glob("*/*.yaml")):
        p = pack(yaml.safe_load(path.read_text()))
        if (p.domain, p.entity) != (path.parent.name, path.stem):
            raise PackError(f"{path}: its name and its content differ")
        if (p.domain, p.entity) in out:
            raise PackError(f"{path}: a second pack")
        out[p.domain, p.entity] = p
    return list(out.values())
