"""Audits, reports and the command line."""

from __future__ import annotations

import hashlib
import json

import pytest

from spanloom import __main__ as cli
from spanloom.operators import audit
from spanloom.plans import report


def test_elision():
    text = "".join(chr(97 + k % 26) for k in range(3000))
    parts = audit.elide(text, (0, 3000), (1500, 1510))
    assert [k for k, _ in parts] == ["text", "gap", "text", "inner", "text", "gap", "text"]
    assert parts[3][1] == text[1500:1510] and len(parts[0][1]) == 350
    assert "".join(t for _, t in audit.elide(text, (0, 600), (100, 110))) == text[:600]


@pytest.mark.parametrize("inner", [(0, 10), (5, 9), (40, 60), (0, 100), (90, 100), (50, 50)])
def test_elision_shows_what_is_near(inner):
    """Each character by itself: shown if near the outer span's ends or the inner span."""
    text = "".join(chr(0x4E00 + k) for k in range(120))
    want = ""
    for x in range(10, 110):
        shown = x < 10 + 7 or x >= 110 - 7 or inner[0] + 10 - 4 <= x < inner[1] + 10 + 4
        want += text[x] if shown else ("" if want.endswith("_") else "_")
    got = audit.elide(text, (10, 110), (inner[0] + 10, inner[1] + 10), 7, 7, 4)
    assert "".join("_" if k == "gap" else t for k, t in got) == want
    assert "".join(t for k, t in got if k == "inner") == text[inner[0] + 10 : inner[1] + 10]


def test_audit_round_trip(tmp_path):
    strata = {1: [{"text": "a < b", "labels": ["FACTS"]}], 3: [{"text": "x", "outer_labels": ["ISSUE"], "inner_labels": ["ANALYSIS"]}], 4: [{"text": "y", "max_roles": ["FACTS", "ISSUE"]}]}
    items, key, manifest = audit.build(strata, 7)
    assert [i["item_id"] for i in audit.build(strata, 7)[0]] == [i["item_id"] for i in items]
    page = audit.from_frozen(items, manifest)
    assert "a &lt; b" in page and "outer_roles" in page and not any("labels" in i for i in items)
    with pytest.raises(ValueError):
        audit.from_frozen(items[1:], manifest)
    got = audit.score(key, {"E1-01": {"roles": ["FACTS", "ISSUE"]}, "E3-01": {"valid_units": "YES", "outer_roles": ["ISSUE"], "inner_roles": ["FACTS"]}})
    assert got[1]["set_f1"] == 0.6667 and got[3]["set_f1"] == 0.5 and got[3]["choices"] == {"valid_units": {"YES": 1}} and got[4]["answered"] == 0
    assert audit.score(key, {"E9-01": {}})["unknown"] == ["E9-01"]
    choice = audit.score(key, {"E4-01": {"single_role_faithful": "YES", "single_role": "FACTS", "roles": ["LAW_REFERENCE"]}, "E1-01": {"roles": ["UNCERTAIN"]}})
    assert choice[4]["compared"] == 1 and choice[4]["set_f1"] == 0.6667 and choice[1]["unanswered"] == 0 and choice[1]["uncertain"] == 1 and choice[3]["unanswered"] == 1
    form = json.dumps({"ratified": "YES", "reason": "r"}).encode()
    assert audit.record_ratification(form, str(tmp_path)) == {"sha256": hashlib.sha256(form).hexdigest(), "ratified": "YES", "has_reason": True}
    with pytest.raises(ValueError):
        audit.record_ratification(b"{}", str(tmp_path))
    assert "UNCERTAIN" in audit.ratification_form(got)
    assert audit.archive(b"{}", str(tmp_path)) == audit.archive(b"{}", str(tmp_path))
    assert "all roles" in audit.prompt("t", {}, True)


def test_report():
    assert report.table([{"a": 1.25, "b": "x|y"}]) == "| a | b |\n|---|---|\n| 1.25 | x\\|y |\n"


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "projection_stats" in capsys.readouterr().out
    doc = {"text": "Some text.", "text_len": 10, "spans": [{"begin": 0, "end": 4, "label": "FACTS"}]}
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json").write_text(json.dumps(doc))
    assert cli.main(["check", f"file://{tmp_path}/good"]) == 0
    (tmp_path / "good" / "b.json").write_text(json.dumps(doc | {"text_len": 9}))
    assert cli.main(["check", f"file://{tmp_path}/good"]) == 1


def test_manifest_commands(spark, tmp_path, capsys):
    root, out = f"{tmp_path}/corpus", {k: f"{tmp_path}/{k}.json" for k in ("audit", "dedup", "grid", "split")}
    assert cli.main(["mock", root]) == 0
    folder = f"file://{root}/Annotator_C"
    assert cli.main(["audit", folder, out["audit"]]) == 0
    found = json.loads(open(out["audit"]).read())
    assert found["documents"] == 4 and found["multi_role"] == {"2": 4} and found["nesting"] >= 4 and found["documents_with_crossing"] == 4
    assert cli.main(["dedup", folder, out["dedup"]]) == 0 and cli.main(["freeze-grid", folder, out["grid"]]) == 0
    assert json.loads(open(out["grid"]).read())["n_sentences"] == 44
    groups = json.loads(open(out["dedup"]).read())["groups"]
    sizes = f"train={sum(map(len, groups)) - len(groups[-1])},test={len(groups[-1])}" if len(groups) > 1 else "train=4,test=0"
    assert cli.main(["split", folder, out["dedup"], out["split"], "--sizes", sizes]) == 0
    assert cli.main(["verify", folder, out["grid"], out["split"]]) == 0
    with pytest.raises(SystemExit):
        cli.main(["freeze-grid", folder, out["grid"]])
    path = f"{root}/Annotator_C/M0000.json"
    body = json.loads(open(path).read())
    body["text"] += " More of it."
    del body["text_sha256"]
    open(path, "w").write(json.dumps(body))
    capsys.readouterr()
    assert cli.main(["verify", folder, out["grid"], out["split"]]) == 1
    assert "grid M0000 text" in capsys.readouterr().out
