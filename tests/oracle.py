"""A query's rows beside its SQL's."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tidy(x):
    if isinstance(x, float):
        return round(x, 5) + 0.0
    return tuple(map(tidy, x)) if isinstance(x, (list, tuple)) else x


def compare(spark, query, sql, sf_dir):
    with duckdb.connect() as c:
        for t in TABLES:
            if Path(f"{sf_dir}/{t}.parquet").exists():
                c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = c.sql(sql)
        names, wanted = found.columns, found.fetchall()
    df = query(spark, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tidy([r[n] for n in names]) for r in df.collect()), key=repr)
    assert got == sorted((tidy(r) for r in wanted), key=repr)
