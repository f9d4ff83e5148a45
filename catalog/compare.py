"""Compare a registered query with its SQL, ignoring row order."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _cell(x)) for k, x in v.items()))
    return v


_KINDS = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean",
          "DOUBLE": "double"}


def compare(df, con, sql) -> list[str]:
    """Differences found; empty when schema and rows agree."""
    names = sorted(df.columns)
    rel = con.sql(sql)
    if sorted(rel.columns) != names:
        return [f"columns {names} versus {sorted(rel.columns)}"]
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    problems = [f"type of {f.name}: {f.dataType.simpleString()} versus {kinds[f.name]}"
                for f in df.schema if _KINDS.get(kinds[f.name], "?") != f.dataType.simpleString()
                and not kinds[f.name].endswith("[]")]
    mine = Counter(tuple(_cell(r[n]) for n in names) for r in df.collect())
    at = [rel.columns.index(n) for n in names]
    theirs = Counter(tuple(_cell(r[i]) for i in at) for r in rel.fetchall())
    if mine != theirs:
        problems.append(f"{sum(mine.values())} rows versus {sum(theirs.values())}; columns {names}")
        problems += [f"only Spark: {x}" for x in list((mine - theirs).elements())[:3]]
        problems += [f"only SQL:   {x}" for x in list((theirs - mine).elements())[:3]]
    if not mine:
        problems.append("no rows")
    return problems
