"""Tables stored as folders of files, read by the streaming queries."""

import pytest

from seclake.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("folder"))
    rows = [(i, f"key = 'AKIAABCDEFGHIJKLMNO{i % 10}'", "en", "src", 5) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{place}/documents.parquet")
    return place


def test_streams_read_tables_of_several_files(spark, folder):
    found = lambda key: sorted(map(tuple, QUERIES[key](spark, folder).collect()), key=str)
    assert found("str01_scan_stream") == found("set01_all_findings") != []
    assert found("str03_verify_stream")
