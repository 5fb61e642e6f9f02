"""Queries do the whole job: every row of a lens takes part."""

import pytest

from docketlake.plans import catalog, q_files
from docketlake.plans.lenses import lens

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, of, mark", [("src3_ledes_billing", "billing", "|M-"), ("src4_ofx_statements", "txn", "<STMTTRN>"), ("src5_chat_export", "comm", ": message "), ("src12_json_intake", "intake", '"client_id"')])
def test_sources_write_every_row(spark, tmp_path, monkeypatch, name, of, mark):
    monkeypatch.setattr(q_files, "_folder", lambda df, kind: f"{tmp_path}/{kind}")
    monkeypatch.setattr(q_files, "FILE_ROWS", 100)
    got = catalog.queries()[name](spark, SF).count()
    files = list(tmp_path.rglob("*.txt"))
    n = lens(spark, SF, of).count()
    assert sum(f.read_text().count(mark) for f in files) == n == got > 0
    assert len({f.name for f in files}) == len(files) >= n / 200


def test_text_blocks_write_every_document(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(q_files, "_folder", lambda df, kind: f"{tmp_path}/{kind}")
    catalog.queries()["src11_text_blocks"](spark, SF).collect()
    want = lens(spark, SF, "block").select("doc_id").distinct().count()
    assert sum(f.read_text().startswith("# ") + f.read_text().count("\n# ") for f in tmp_path.rglob("*.txt")) == want
