import duckdb
import pytest

import oracle_check
from quillstone.plans import slips
from quillstone.streaming import append_rows, read_stream


@pytest.mark.parametrize("name", [*slips.queries(), "tax_numbers"])
def test_rows_are_those_of_the_sql(spark, sf, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("orders", "ocr_results"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(slips.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and oracle_check.canonical(got) == oracle_check.canonical(want) and len(got)


def test_append_of_an_empty_stream(spark, sf):
    rows = append_rows(read_stream(spark, sf, "ocr_results").filter("ocr_id < 0").select("ocr_id"))
    assert rows.columns == ["ocr_id"] and rows.count() == 0
