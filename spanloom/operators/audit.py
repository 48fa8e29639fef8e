"""Blind audits: items with context, their questionnaire, the scoring of answers, and prompts for outside models. Items are few (tens), so these run on the driver."""

from __future__ import annotations

import hashlib
import html
import itertools
import json
import random
from collections.abc import Iterable
from pathlib import Path

from ..functions.roles import ROLES

HEAD = TAIL = 350
AROUND = 250


def elide(text: str, outer: tuple[int, int], inner: tuple[int, int], head: int = HEAD, tail: int = TAIL, around: int = AROUND) -> list[tuple[str, str]]:
    """Parts of an outer span as (kind, text): its head, its tail and the inner span's surroundings stay, and each run of what is left out is one gap. The inner span is marked.

    A sweep over the ranges' ends: between two ends the text is shown if any shown range is open, and inner if the inner span is.
    """
    begin, end = outer
    shown = [(begin, begin + head), (inner[0] - around, inner[1] + around), (end - tail, end)]
    clip = lambda x: max(begin, min(end, x))
    ends = sorted({begin, end, *(clip(x) for r in (*shown, inner) for x in r)})
    out: list[tuple[str, str]] = []
    for x, y in itertools.pairwise(ends):
        if inner[0] <= x < inner[1]:
            kind = "inner"
        else:
            kind = "text" if any(clip(p) <= x < clip(q) for p, q in shown) else "gap"
        part = "" if kind == "gap" else text[x:y]
        if out and out[-1][0] == kind:
            out[-1] = kind, out[-1][1] + part
        else:
            out.append((kind, part))
    return out


def display_order(items: list[dict], seed: int) -> list[dict]:
    """Items in a seeded order that mixes the strata, each with its place."""
    shuffled = sorted(items, key=lambda i: i["item_id"])
    random.Random(seed).shuffle(shuffled)
    return [i | {"display_order": k} for k, i in enumerate(shuffled)]


def build(strata: dict[int, list[dict]], seed: int) -> tuple[list[dict], list[dict], dict]:
    """Public items without labels, the private key, and a manifest with the hashes of both."""
    numbered = [row | {"item_id": f"E{s}-{k:02d}", "stratum": s} for s, rows in sorted(strata.items()) for k, row in enumerate(rows, 1)]
    hidden = {"labels", "outer_labels", "inner_labels", "max_roles"}
    items = display_order([{k: v for k, v in row.items() if k not in hidden} for row in numbered], seed)
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    return items, numbered, {"seed": seed, "n_items": len(items), "items_sha256": digest(items), "key_sha256": digest(numbered)}


def from_frozen(items: list[dict], manifest: dict) -> str:
    """The questionnaire of items that are still those of the manifest."""
    if hashlib.sha256(json.dumps(items, sort_keys=True, ensure_ascii=False).encode()).hexdigest() != manifest["items_sha256"]:
        raise ValueError("the items have changed since they were frozen")
    return questionnaire(items)


def questionnaire(items: list[dict], title: str = "Questionnaire") -> str:
    """A page with a form for each item, in display order, whose answers can be saved as JSON."""
    boxes = lambda name: " ".join(f'<label><input type="checkbox" name="{name}" value="{r}">{r}</label>' for r in ROLES)
    choice = lambda name: " ".join(f'<label><input type="radio" name="{name}" value="{v}">{v}</label>' for v in ("YES", "NO", "UNCERTAIN"))
    safe = lambda s: html.escape(s).replace("\n", "<br>")
    parts = []
    for i in sorted(items, key=lambda i: i["display_order"]):
        name = i["item_id"]
        context = f'<p><span class="c">{safe(i.get("pre", ""))}</span><mark>{safe(i.get("text", ""))}</mark><span class="c">{safe(i.get("post", ""))}</span></p>'
        asked = {3: f"<p>{choice(name + ':valid_units')}</p><p>{boxes(name + ':outer_roles')}</p><p>{boxes(name + ':inner_roles')}</p>", 4: f"<p>{choice(name + ':single_role_faithful')}</p><p>{boxes(name + ':roles')}</p>"}
        parts.append(f'<fieldset data-item="{name}"><legend>{name}</legend>{context}{asked.get(i["stratum"], "<p>" + boxes(name + ":roles") + "</p>")}</fieldset>')
    save = "function save(){const o={};for(const x of document.querySelectorAll('input:checked')){const[i,k]=x.name.split(':');o[i]??={};if(x.type=='radio')o[i][k]=x.value;else(o[i][k]??=[]).push(x.value)}const a=document.createElement('a');a.href=URL.createObjectURL(new Blob([JSON.stringify(o)]));a.download='responses.json';a.click()}"
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>.c{{color:#777}}</style></head><body><h1>{html.escape(title)}</h1><form>{"".join(parts)}</form><button onclick="save()">Save</button><script>{save}</script></body></html>'


def set_f1(a: Iterable[str], b: Iterable[str]) -> float:
    x, y = set(a), set(b)
    return 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))


#: By stratum, which answers are compared with which labels of the key, and which question is a choice.
COMPARED = {1: [("roles", "labels")], 2: [("roles", "labels")], 3: [("outer_roles", "outer_labels"), ("inner_roles", "inner_labels")], 4: [("roles", "max_roles")]}
CHOICES = {3: "valid_units", 4: "single_role_faithful"}


def read_answer(stratum: int, response: dict) -> dict:
    """The choice, whether any role list says UNCERTAIN, whether the item counts as answered, and the role sets to compare by the key's label.

    Without a choice to make, roles or UNCERTAIN are an answer. Where one role is said to be faithful (stratum 4),
    that role is compared with the key, and where it is not, the roles.
    """
    lists = {label: response.get(name) or [] for name, label in COMPARED[stratum]}
    choice = response.get(CHOICES[stratum]) if stratum in CHOICES else None
    if stratum == 4:
        single = response.get("single_role")
        lists = {"max_roles": lists["max_roles"] if choice == "NO" else [single] if choice == "YES" and single else []}
    unsure = any("UNCERTAIN" in v for v in lists.values())
    sets = {label: kept for label, v in lists.items() if (kept := set(v) & set(ROLES))}
    return {"choice": choice, "unsure": unsure, "sets": sets, "answered": choice is not None if stratum in CHOICES else bool(sets) or unsure}


def score(key: list[dict], responses: dict[str, dict]) -> dict:
    """By stratum: items, answered, unanswered and uncertain ones, those with several roles, agreement with the key in set F1 and exactly, and how often each choice was YES, NO or UNCERTAIN; at "unknown" the answers to items that the key lacks."""
    out: dict = {"unknown": sorted(set(responses) - {k["item_id"] for k in key})}
    for stratum, group in itertools.groupby(sorted(key, key=lambda r: r["stratum"]), key=lambda r: r["stratum"]):
        rows = list(group)
        read = [read_answer(stratum, responses.get(r["item_id"], {})) for r in rows]
        f1 = [set_f1(given, r[label]) for r, x in zip(rows, read, strict=True) for label, given in x["sets"].items() if label in r]
        made = [x["choice"] for x in read if x["choice"] is not None]
        out[stratum] = {
            "n": len(rows),
            "answered": sum(x["answered"] for x in read),
            "unanswered": sum(not x["answered"] for x in read),
            "uncertain": sum(x["unsure"] for x in read),
            "several": sum(any(len(v) > 1 for v in x["sets"].values()) for x in read),
            "compared": len(f1),
            "set_f1": round(sum(f1) / len(f1), 4) if f1 else None,
            "exact": round(sum(x == 1 for x in f1) / len(f1), 4) if f1 else None,
            "choices": {CHOICES[stratum]: {v: made.count(v) for v in sorted(set(made))}} if made else {},
        }
    return out


def archive(responses: bytes, folder: str) -> Path:
    """Keeps answers under the hash of their bytes; the same answers are kept once."""
    path = Path(folder) / f"{hashlib.sha256(responses).hexdigest()}.json"
    if not path.exists():
        path.write_bytes(responses)
    return path


def ratification_form(summary: dict, title: str = "Ratification") -> str:
    """A page that asks whether the scored audit is accepted, with its figures and room for a reason."""
    rows = "".join(f"<tr><td>{html.escape(str(k))}</td><td>{html.escape(json.dumps(v, sort_keys=True))}</td></tr>" for k, v in summary.items())
    asked = " ".join(f'<label><input type="radio" name="ratified" value="{v}">{v}</label>' for v in ("YES", "NO", "UNCERTAIN"))
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table>{rows}</table><form><p>{asked}</p><textarea name="reason"></textarea></form></body></html>'


def record_ratification(answer: bytes, folder: str) -> dict:
    """Keeps the bytes of a filled form by their hash and gives a summary of it: the hash, the verdict and whether there is a reason."""
    found = json.loads(answer)
    if found.get("ratified") not in ("YES", "NO", "UNCERTAIN"):
        raise ValueError("the form has no verdict")
    return {"sha256": archive(answer, folder).stem, "ratified": found["ratified"], "has_reason": bool(found.get("reason"))}


def prompt(text: str, definitions: dict[str, str], multi: bool) -> str:
    """A request to name the role, or all roles, of a text."""
    listed = "\n".join(f"- {r}: {definitions.get(r, '')}" for r in ROLES)
    ask = "all roles that apply" if multi else "the one role that fits best"
    return f"Roles:\n{listed}\n\nName {ask} to this text, in brackets, by the names above.\n\n{text}\n"
