"""Result rows as comparable text, columns sorted by name."""

import math


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    return f"{float(v):.6f}" if isinstance(v, (int, float)) else str(v)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted(tuple(cell(r[c]) for c in names) for r in df.collect())


def duck_rows(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(cell(r[i]) for i in order) for r in found.fetchall()), sorted(names)
