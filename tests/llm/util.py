import duckdb

TABLES = "documents pages labels benchmark conversations embeddings events orders lineitem customer supplier part nation region".split()


def sql_rows(sql, sf="/root/testdata/sf0.001", **tables):
    """The rows of DuckDB SQL over the test tables, or over the pandas frames given."""
    con = duckdb.connect()
    for t in TABLES:
        if t in tables:
            con.register(t, tables[t])
        else:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=found.columns.__getitem__)
    return sorted([[r[i] for i in order] for r in found.fetchall()], key=repr)


def spark_rows(df):
    columns = sorted(df.columns)
    return sorted([[r[c] for c in columns] for r in df.collect()], key=repr)
