"""JOB-shaped queries over seeded rows of the benchmark's 21 tables, against DuckDB."""

import random

import duckdb
import pytest

from weftline.plans.catalog import JOB_COLUMNS, job_schema
from weftline.plans.sqlfront import execute, oracle_text, parse

ROWS = {"title": 60, "cast_info": 300, "name": 50, "movie_info": 200, "movie_keyword": 150, "movie_companies": 120}
SHORT = {"role_type": 6, "kind_type": 5, "info_type": 8, "link_type": 4, "company_type": 3, "comp_cast_type": 3}
WORDS = ["actor", "Drama", "(voice)", "USA", "[us]", "sequel", "A film_1", "it's", "Tim", "100%"]
QUERIES = {
    "companies": "SELECT MIN(t.title), MIN(cn.name) FROM title t, movie_companies mc, company_name cn WHERE t.id = mc.movie_id AND mc.company_id = cn.id AND cn.country_code <> 'USA' AND t.production_year BETWEEN 1990 AND 2010",
    "keywords": "SELECT MIN(k.keyword) AS kw, MIN(t.title) AS movie FROM keyword k, movie_keyword mk, title t, kind_type kt WHERE mk.movie_id = t.id AND k.id = mk.keyword_id AND kt.id = t.kind_id AND (k.keyword LIKE '%e%' OR k.keyword IN ('Tim', 'it''s'))",
    "closure": "SELECT MIN(mi.info), MIN(mi_idx.info) FROM title t, movie_info mi, movie_info_idx mi_idx, info_type it WHERE t.id = mi.movie_id AND t.id = mi_idx.movie_id AND mi.movie_id = mi_idx.movie_id AND it.id = mi.info_type_id AND mi.note IS NOT NULL",
    "people": "SELECT MIN(n.name, an.name), MIN(chn.name) FROM name n, aka_name an, cast_info ci, char_name chn, role_type rt, title t WHERE n.id = an.person_id AND an.person_id = ci.person_id AND ci.movie_id = t.id AND chn.id = ci.person_role_id AND rt.id = ci.role_id AND NOT rt.role = 'sequel'",
    "links": "SELECT MIN(t1.title), MIN(t2.title) FROM title t1, title t2, movie_link ml, link_type lt WHERE ml.movie_id = t1.id AND ml.linked_movie_id = t2.id AND lt.id = ml.link_type_id AND t2.production_year > 1995 -- both sides",
    "complete": "SELECT MIN(t.title) FROM complete_cast cc, comp_cast_type c1, comp_cast_type c2, title t, aka_title alt WHERE cc.subject_id = c1.id AND cc.status_id = c2.id AND cc.movie_id = t.id AND alt.movie_id = t.id AND t.production_year IS NOT NULL",
    "six": "SELECT MIN(pi.info), MIN(n.name) FROM person_info pi, info_type it, name n, cast_info ci, title t, movie_keyword mk WHERE pi.person_id = n.id AND it.id = pi.info_type_id AND ci.person_id = n.id AND ci.movie_id = t.id AND mk.movie_id = t.id AND n.gender IS NOT NULL AND t.production_year >= 1985",
}


def made(table):
    rng = random.Random(table)
    out = []
    for k in range(1, SHORT.get(table, ROWS.get(table, 40)) + 1):
        row = []
        for f in job_schema(table):
            if f.name == "id":
                row.append(k)
            elif rng.random() < 0.1:
                row.append(None)
            elif f.dataType.simpleString() == "string":
                row.append(rng.choice(WORDS) + rng.choice(["", " x", "e"]))
            elif "year" in f.name:
                row.append(rng.randint(1980, 2015))
            else:
                row.append(rng.randint(1, {"kind_id": 5, "role_id": 6, "info_type_id": 8, "link_type_id": 4, "company_type_id": 3, "subject_id": 3, "status_id": 3}.get(f.name, 45)))
        out.append(tuple(row))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    con = duckdb.connect()
    frames = {}
    for table, columns in JOB_COLUMNS.items():
        rows = made(table)
        con.execute(f"CREATE TABLE {table} ({columns.replace(' string', ' VARCHAR')})")
        con.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * len(rows[0]))})", rows)
        frames[table] = spark.createDataFrame(rows, job_schema(table)).cache()
    yield frames, con
    for df in frames.values():
        df.unpersist()


def test_all_tables_are_there(tables):
    assert len(tables[0]) == 21


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_raw_rows(tables, name):
    frames, con = tables
    text = QUERIES[name]
    query = parse(text, lambda t: frames[t].columns)
    order = lambda rows: sorted(rows, key=lambda r: [(v is not None, v) for v in r])
    got = order(tuple(r) for r in execute(query, frames.__getitem__, mode="raw").collect())
    assert got == order(con.execute(oracle_text(query, text)).fetchall()) and got


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if "n.name, an.name" not in q))
def test_aggregates(tables, name):
    frames, con = tables
    got = execute(parse(QUERIES[name], lambda t: frames[t].columns), frames.__getitem__).collect()
    assert [tuple(r) for r in got] == con.execute(QUERIES[name]).fetchall()
