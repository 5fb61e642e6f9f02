"""Case by letter: mail with letters whose upper case is two agrees with its SQL twin."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketlake.functions.core import lower_by_letter, upper_by_letter
from docketlake.plans import catalog
from tests.oracle import connection, same

ODD = ["Stra\u00dfe", "\u00df\u00df", "\ufb01x \u0149", "\u0391\u03a3 \u0391\u03a3\u0391", "\u0130x", "\u1fb3\u1fb2", "plain", "", "\U00010d70a\u1e9e"]


def test_case_agrees_with_sql(spark):
    import duckdb

    con, df = duckdb.connect(), pd.DataFrame({"t": ODD})
    want = con.sql("SELECT t, upper(t), lower(t) FROM df").fetchall()
    got = spark.createDataFrame(df).select("t", upper_by_letter(F.col("t")), lower_by_letter(F.col("t"))).collect()
    assert sorted(want) == sorted(map(tuple, got))


@pytest.mark.parametrize("name", ["eag1_top_senders", "eag2_mail_per_day", "eml2_duplicates", "eml3_content_hash", "src6_eml_files", "src7_mailbox_lines", "src7_mbox_files", "grf14_mail_network"])
def test_mail_with_odd_letters(spark, tmp_path, name):
    rows = [(c, t, "user", f"{ODD[(c + t) % len(ODD)]} of {c // 10}") for c in range(0, 60, 5) for t in range(3)]
    pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).to_parquet(tmp_path / "conversations.parquet")
    con = connection("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet'")
    assert same(catalog.queries()[name](spark, str(tmp_path)), con, catalog.oracle_sql()[name])
