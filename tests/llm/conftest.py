import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Runs a registered query and its SQL over a folder's tables."""
    import duckdb

    from threadloom.llm import queries

    def check(name, sf_dir=SF):
        con = duckdb.connect()
        for t in ("documents", "embeddings", "benchmark", "labels", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = con.execute(queries.oracle_sql()[name])
        names = [c[0] for c in want.description]
        want = sorted(map(str, (tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall())))
        got = queries.queries()[name](spark, sf_dir)
        assert sorted(got.columns) == sorted(names)
        assert sorted(str(tuple(r[c] for c in sorted(names))) for r in got.collect()) == want

    return check
