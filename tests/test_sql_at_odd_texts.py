"""Span queries against their SQL on texts that the small tables do not hold."""

import duckdb
import pytest
from quarry import registry

registry.load()

TEXTS = [
    "vivid words at the start. And a last v", "v", "vv. V v", " v\t", "One v. Two ", " Three.  Four\x0b", "\x1cFive. \x1fSix\x85", "a\x01b. C\x01",
    "Ends in Mr. Vv. Next vs. Then", "no mark", "", None, ". . . A", "x" + "." * 3000 + " B", "y" + " " * 3000 + "! C", "v" * 4600, ("word v " * 1400) + "v",
    "v" + " \n\t" * 20 + "end.\x0bX. \x0bY", "Ä. Ö. Z", "\U0001f600. Á v",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("texts"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", ["offset_chunks", "sentence_split"])
def test_equals_sql(spark, folder, name):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    want = sorted(map(repr, duck.execute(registry.ORACLE_SQL[name]).fetchall()))
    assert sorted(repr(tuple(r)) for r in registry.QUERIES[name](spark, folder).collect()) == want
