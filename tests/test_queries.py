"""Every query that has SQL gives the same rows in DuckDB; the others give rows."""

import pytest

from tests.oracle import compare
from textloom.queries import ORACLE_SQL, QUERIES
from textloom.queries.text import MISSPELLED


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_like_sql(spark, sf, name):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_gives_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "score", "snippet"]
    assert df.count() == 10


def test_closest_word_may_be_accented(spark, tmp_path):
    texts = ["téh wích wròk", "tehx0 wichx0 adnx0 other naïve wörk"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    words = [w for t in texts for w in t.split()]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    got = {r.word: (r.correction, r.distance) for r in QUERIES["spell_closest"](spark, str(tmp_path)).collect()}
    assert got == {q: min(((w, distance(q, w)) for w in words), key=lambda x: x[1]) for q in MISSPELLED}
    assert got["teh"] == ("téh", 1) and got["wich"] == ("wích", 1)
