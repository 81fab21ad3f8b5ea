"""Compare a query with its DuckDB twin as multisets of rows."""

import tempfile

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NUMBERS = ("BIGINT", "INTEGER", "DOUBLE", "FLOAT", "HUGEINT", "SMALLINT", "TINYINT")


def differing(df, sql: str, sf_dir: str) -> int:
    """Rows on one side only; -1 if the columns differ."""
    path = tempfile.mkdtemp(prefix="oracle-") + "/rows"
    df.write.parquet(path)
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    c.execute(f"CREATE TABLE b AS {sql}")
    c.execute(f"CREATE TABLE a AS SELECT * FROM '{path}/*.parquet'")
    types = {r[0]: r[1] for r in c.execute("DESCRIBE a").fetchall()}
    if sorted(types) != sorted(r[0] for r in c.execute("DESCRIBE b").fetchall()):
        return -1
    text = lambda n: f"coalesce(CAST({f'CAST({n} AS DOUBLE)' if types[n] in NUMBERS or types[n].startswith('DECIMAL') else n} AS VARCHAR), '~')"
    key = lambda t: f"SELECT {' || chr(1) || '.join(map(text, sorted(types)))} AS r, count(*) AS n FROM {t} GROUP BY 1"
    return c.execute(f"SELECT count(*) FROM (({key('a')} EXCEPT {key('b')}) UNION ALL ({key('b')} EXCEPT {key('a')}))").fetchall()[0][0]
