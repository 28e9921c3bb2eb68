import duckdb
import pytest


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source) rows, with columns whose names clash with those used inside."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1]), 1, 2, "x") for r in rows]
        schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, _id int, bands string"
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture
def against(spark):
    """Compares rows with SQL over given frames."""

    def compare(df, sql, **tables):
        con = duckdb.connect()
        for name, frame in tables.items():
            con.register(name, frame.toArrow())
        rel = con.sql(sql)
        names = sorted(rel.columns)
        assert sorted(df.columns) == names
        want = sorted(map(str, rel.project(", ".join(f'"{c}"' for c in names)).fetchall()))
        assert sorted(str(tuple(r)) for r in df.select(*names).collect()) == want

    return compare
