"""A query's rows held against its SQL, as sorted strings of their values."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(repr([v[i] for i in order]) for v in values)


def both(spark, query, statement: str, sf_dir: str):
    found = query(spark, sf_dir)
    ours = rows(found.columns, [tuple(r) for r in found.collect()])
    held = connect(sf_dir).execute(statement)
    return ours, rows([d[0] for d in held.description], held.fetchall())
