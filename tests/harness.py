"""Run a query and its SQL on the same files and compare rows."""

from __future__ import annotations

import math

import duckdb

from gitstrata.plans.fixtures import BASE_TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        r = round(v, 6)
        return 0.0 if r == 0 else r
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in sorted(v.items())}
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(df, con, sql):
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if got != want:
        only_got = [r for r in got if r not in want][:3] if len(got) < 3000 else []
        for g, w in zip(got, want):
            if g != w:
                return f"rows {len(got)} vs {len(want)}; first diff\n  got  {str(g)[:600]}\n  want {str(w)[:600]}\n  extra {str(only_got)[:600]}"
        return f"rows {len(got)} vs {len(want)}; extra {only_got or got[len(want):len(want)+2] or want[len(got):len(got)+2]}"[:900]
    if not got:
        return "EMPTY"
    return None
