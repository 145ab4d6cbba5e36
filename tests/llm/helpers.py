"""DuckDB over the tables that these operators read."""

import os

from checks.runall import connect

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def corpus_connection(sf_dir):
    con = connect(sf_dir)
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"create or replace view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con
