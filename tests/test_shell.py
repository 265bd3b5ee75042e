"""A store from nothing to relations, by commands."""

import json
import re

from claimloom import __main__ as shell


def reader(prompt):
    """Proposes "NAME of YEAR: VALUE" lines."""
    return json.dumps([{"subject": "Mill", "attribute": a, "period": y, "value": v, "evidence_quote": f"{a} of {y}: {v}", "confidence": 0.9} for a, y, v in re.findall(r"(\w+) of (FY\d\d): (₹\d+ Cr)", prompt)] + [{"attribute": "x", "value": "1", "evidence_quote": "not to be found at all"}])


def test_a_store(spark, tmp_path, capsys):
    for name, text in (("a.txt", "sales of FY17: ₹200 Cr\nstock of FY17: ₹40 Cr"), ("b.txt", "Sales of FY17: ₹200 Cr and it was good"), ("c.txt", "sales of FY17: ₹200 Cr\nstock of FY17: ₹40 Cr")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    run = lambda *a: shell.main([*a, "--store", str(tmp_path / "store")], spark)
    for _ in range(2):
        run("ingest", str(tmp_path / "*.txt"))
    assert capsys.readouterr().out.split("\n")[:2] == ["2 new documents", "0 new documents"]
    store = shell.Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        run("extract", "--model", "test_shell:reader")
    assert store.read("facts").count() == 3 and "3 facts, 2 turned down\n0 facts" in capsys.readouterr().out
    run("link")
    for _ in range(2):
        run("reconcile")
    rel = store.read("relations").collect()
    assert [(r.type, r.decided_by) for r in rel] == [("CORROBORATES", "rule")] and "the values agree" in rel[0].explanation
    fact = store.read("facts").agg({"id": "min"}).first()[0]
    for c in (["docs"], ["blocks", str(store.read("documents").first().doc_id)], ["facts", "-q", "SALES"], ["review"], ["relations", "--cross-document"], ["schema"], ["evidence", str(fact)]):
        run(*c)
    out = capsys.readouterr().out
    assert "quote not found in the source text" in out and "CORROBORATES" in out and "|quote|" in out.replace(" ", "")
    shell.main(["queries"])
    assert "L1_lines" in capsys.readouterr().out
