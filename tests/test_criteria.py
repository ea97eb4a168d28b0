"""The criterion judge on small documents, specs and settings from files."""

import json

import pytest

from tallyforge.operators import criteria as K

SPEC = {"slug": "s", "criteria": [{"id": "C1", "kind": "alias", "words": ["shipped", "req/min"]}, {"id": "C2", "kind": "named_in", "anchor": "C1"}, {"id": "C3", "kind": "number_in", "anchor": "C1"}, {"id": "C4", "kind": "alias", "requires": "C2", "words": ["tests"]}, {"id": "C5", "kind": "unhedged_in", "anchor": "C1"}, {"id": "C6", "kind": "none"}]}
SHAPE = "id int, text string, summary string, roles array<struct<heading:string,bullets:array<string>>>"


def answers(spark, docs, spec=SPEC):
    out = {}
    for r in K.answered(spark.createDataFrame(docs, SHAPE), "id", spec).collect():
        out.setdefault(r.id, {})[r.criterion] = r.met
    return out


def test_chain(spark):
    docs = [
        (1, "", "", [("a", ["nothing here", "Shipped it in 3 weeks"]), ("b", ["wrote tests for PyTorch"])]),
        (2, "", "", [("a", ["We shipped it", "with PyTorch and tests"])]),
        (3, "", "", [("a", ["reshipped the goods with PyTorch"])]),
        (4, "", "", [("a", [])]), (5, "", "", []), (6, None, None, None),
        (7, "", "", [("a", ["9 req/min on vLLM, with tests"])]),
    ]
    got = answers(spark, docs)
    assert {k: "".join("-" if v is None else str(int(v)) for _, v in sorted(x.items())) for k, x in got.items()} == {1: "10101" + "-", 2: "11010" + "-", 3: "00000" + "-", 7: "11111" + "-"}


def test_document_kinds(spark):
    spec = {"slug": "d", "criteria": [{"id": k, "kind": k} for k in ("identity", "outcome_per_role", "roles_differ", "unportable")]}
    same = ["Reduced invoices matched manually across warehouses", "Reduced invoices matched manually across warehouses"]
    docs = [(1, "Ann\nSenior data engineer\nJob one\nx", "", [("Job one", same[:1]), ("Job two", same[1:])]), (2, "Ann\nJob one\nSenior data engineer", "", [("Job one", ["Cut cost by 4%"]), ("Job two", ["Was there"])])]
    assert answers(spark, docs, spec) == {1: {"identity": True, "outcome_per_role": True, "roles_differ": False, "unportable": True}, 2: {"identity": False, "outcome_per_role": False, "roles_differ": True, "unportable": True}}


def test_specs_and_settings(tmp_path):
    (tmp_path / "s.json").write_text(json.dumps(SPEC))
    assert [s["slug"] for s in K.read_specs(str(tmp_path))] == ["s"]
    (tmp_path / "t.json").write_text(json.dumps(SPEC))
    with pytest.raises(ValueError):
        K.read_specs(str(tmp_path))
    for bad in ({"id": "C1", "kind": "what"}, {"id": "C1", "kind": "number_in", "anchor": "C9"}):
        with pytest.raises(ValueError):
            K.checked_spec({"slug": "s", "criteria": [bad]})
    (tmp_path / "w.toml").write_text("[ensemble]\nvotes = 3\nk = 2\n[ensemble.economy]\nvotes = 1\n[grades]\nA = 90\n")
    path = str(tmp_path / "w.toml")
    assert K.read_settings(path) == {"ensemble": {"votes": 3, "k": 2}, "grades": {"A": 90}} and K.read_settings(path, "economy")["ensemble"] == {"votes": 1, "k": 2}
