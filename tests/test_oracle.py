"""Every query of the catalogue that has SQL gives the SQL's rows."""

import datetime
import os

import duckdb
import pytest

from lodestrata import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return round(x, 6)
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query(spark, duck, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, want.fetchall())


def test_terms_beside_other_letters(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?)", [
        (1, 0, "De échantion èéè."), (1, 1, "CHANTIONé, chantions"), (1, 2, "a_chantion chantion_"), (2, 0, "(Chantion) chantion"), (2, 1, "chantİon KELVIN\u212aelvin"), (3, 0, None), (None, 0, "chantion")])
    con.execute("CREATE TABLE benchmark AS SELECT * FROM (VALUES (1, 'Échantion ieroian KelvinKelvin'), (2, NULL)) t(item_id, text)")
    for t in ("conversations", "benchmark"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL["mentioned_terms"]).fetchall()
    got = catalogue.QUERIES["mentioned_terms"](spark, str(tmp_path)).select("id", "entry").collect()
    assert rows_of(["id", "entry"], map(tuple, got)) == rows_of(["id", "entry"], want)
    assert {(100, "chantion"), (101, "chantion"), (201, "chantion")} <= set(want) and (102, "chantion") not in want
