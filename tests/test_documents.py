"""Validation of annotated documents by all their fields, and the commands around manifests."""

from __future__ import annotations

import json

import pytest

from spanloom import __main__ as cli
from spanloom.functions.roles import ROLES
from spanloom.operators import validation as V
from spanloom.sources import annotations

TEXT = "One claim. \t  Two facts follow here. A third sentence ends it."


def span(b, e, label="FACTS", **more):
    return {"begin": b, "end": e, "label": label} | more


CASES = {
    "good": {"text": TEXT, "text_len": len(TEXT), "spans": [span(0, 10), span(14, 36, "ISSUE", provenance="reviewed", candidate_source="A")]},
    "length": {"text": TEXT, "text_len": 3, "spans": [span(0, 10)]},
    "bare": {"text": TEXT, "spans": [span(0, 10, kind="entity")]},
    "doubled": {"text": TEXT, "spans": [span(0, 10), span(0, 10), span(0, 10), span(0, 10, "ISSUE"), span(2, 9, "NOBODY"), span(2, 9, "NOBODY")]},
    "bounds": {"text": TEXT, "spans": [span(-1, 5), span(5, 5), span(7, 999), span(10, 14), span(0, 4)]},
    "crossing": {"text": TEXT, "spans": [span(0, 20), span(14, 36, "ISSUE"), span(30, 50), span(0, 3, kind="entity"), span(0, 4, kind="entity")]},
    "late": {"text": TEXT, "notes": {"deep": ["to be Deferred\nby the panel"]}, "spans": [span(0, 10)]},
    "key": {"text": TEXT, "x": {"DEFER": 1}, "spans": [span(0, 10)]},
    "row": {"text": TEXT, "spans": [span(0, 10, comment="defer")]},
    "label": {"text": TEXT, "spans": [span(0, 10, "DEFER")]},
    "text": {"text": "We defer to the court.", "other": "undeferred", "spans": [span(0, 10)]},
}
EXPECTED = {
    ("length", "error", "text_len", 1),
    ("bare", "error", "no_spans", 1), ("bare", "warning", "other_kind", 1),
    ("doubled", "error", "duplicate_rows", 3), ("doubled", "error", "unknown_label", 2),
    ("bounds", "error", "bad_offsets", 3), ("bounds", "error", "blank_slice", 1),
    ("crossing", "warning", "crossing", 2), ("crossing", "warning", "other_kind", 2),
    ("late", "error", "DEFER", 1), ("key", "error", "DEFER", 1), ("row", "error", "DEFER", 1),
    ("label", "error", "DEFER", 1), ("label", "error", "unknown_label", 1),
}


def write(folder, cases):
    folder.mkdir(parents=True, exist_ok=True)
    for name, body in cases.items():
        (folder / f"{name}.json").write_text(json.dumps(body))
    return f"file://{folder}"


def test_everything_wrong_is_named(spark, tmp_path, capsys):
    folder = write(tmp_path / "docs", CASES)
    docs = annotations.load(spark, folder)
    got = {tuple(r) for r in V.documents(docs, annotations.spans(docs), annotations.residue(spark, folder), ROLES).collect()}
    assert got == EXPECTED
    assert cli.main(["check", folder]) == 1
    said = capsys.readouterr().out.splitlines()
    assert len(said) == len(EXPECTED) + 1 and "error late DEFER 1" in said
    assert cli.main(["check", write(tmp_path / "fine", {k: CASES[k] for k in ("good", "crossing", "text")})]) == 0


def test_reviews_by_their_own_fields(spark, tmp_path):
    one = lambda **more: [span(0, 10, "FACTS", **more), span(0, 10, "ISSUE", provenance="panel")]
    made = {
        "a": {"text": TEXT, "merge": {"NOT_human_adjudicated_gold": True}, "spans": one(provenance="panel", candidate_source="A")},
        "b": {"text": TEXT, "spans": one(provenance="unadjudicated_v1")},
        "c": {"text": TEXT, "merge": {"NOT_human_adjudicated_gold": False}, "spans": one(provenance="panel", candidate_source="UNION")},
        "d": {"text": TEXT, "spans": [*one(), span(20, 30, candidate_source="UNION", provenance="x")]},
    }
    folder = write(tmp_path / "docs", made)
    rows = lambda f: annotations.spans(annotations.load(spark, f))
    got = V.reviewed(rows(folder), annotations.residue(spark, folder)).head().asDict()
    assert got == {"regions": 4, "all_reviewed": 1, "with_unreviewed": 1, "with_union": 1, "without_provenance": 1, "rows_with_union": 2, "not_human": 1, "confirmed_by_flags": False}
    clean = write(tmp_path / "clean", {"a": {"text": TEXT, "spans": one(provenance="panel")}})
    assert V.reviewed(rows(clean), annotations.residue(spark, clean)).head().confirmed_by_flags


def test_residue_keeps_whatever_fields_there_are(spark, tmp_path):
    folder = write(tmp_path / "docs", {"a": {"canonical_case_id": "z", "text": "x", "n": 3, "deep": {"k": [1, None]}, "spans": [span(0, 1, extra={"u": True}), span(0, 1)]}, "b": {"text": "y"}})
    got = {r.case_id: r for r in annotations.residue(spark, folder).collect()}
    assert got["z"].meta == {"n": "3", "deep": '{"k":[1,null]}'} and got["z"].span_meta == [{"extra": '{"u":true}'}, {}] and got["b"].span_meta == []


def test_datasets_are_built_only_if_the_manifests_fit(spark, tmp_path, capsys):
    root = str(tmp_path / "mock")
    assert cli.main(["mock", root]) == 0
    folder, out = f"file://{root}/Annotator_C", {k: str(tmp_path / f"{k}.json") for k in ("dedup", "grid", "split")}
    assert cli.main(["dedup", folder, out["dedup"]]) == 0 and cli.main(["freeze-grid", folder, out["grid"]]) == 0
    ids = [r.case_id for r in annotations.load(spark, folder).select("case_id").collect()]
    groups = json.loads(open(out["dedup"]).read())["groups"]
    sizes = "train=4,val=0,test=0" if max(map(len, groups)) > 1 else "train=2,val=1,test=1"
    assert cli.main(["split", folder, out["dedup"], out["split"], "--sizes", sizes, "--grid", out["grid"]]) == 0
    vocabulary = tmp_path / "vocabulary.txt"
    vocabulary.write_text("[PAD]\n[UNK]\n[CLS]\n[SEP]\nsentence\ncase\nof\nhas\nwords\nsome\n.\n##s\n")
    made = f"file://{tmp_path}/made"
    assert cli.main(["build", folder, out["grid"], out["split"], made, "--vocabulary", str(vocabulary)]) == 0
    s1, s2 = spark.read.json(f"{made}/s1"), spark.read.json(f"{made}/s2")
    assert {r.case_id for r in s1.collect()} == set(ids) and s2.count() == 44
    both = s1.filter("is_multi").collect()
    assert both and all(len(r.labels) == r.n_labels > 1 and r.n_subwords > 0 and len(r.text) == r.end - r.begin for r in both)
    assert {r.status for r in s2.collect()} == {"LABELED", "UNLABELED", "AMBIGUOUS"} or "AMBIGUOUS" in {r.status for r in s2.collect()}
    held = json.loads(open(out["split"]).read())
    other = {k: v for k, v in held.items() if k not in ("sha256",)} | {"grid_sha256": "0" * 64}
    annotations.write_manifest(str(tmp_path / "other.json"), other)
    assert cli.main(["verify", folder, out["grid"], str(tmp_path / "other.json")]) == 1
    assert "made for another grid" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        cli.main(["build", folder, out["grid"], str(tmp_path / "other.json"), f"file://{tmp_path}/never"])
    assert not (tmp_path / "never").exists()
