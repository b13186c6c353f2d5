"""Table schemas and table lookup."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: The Join Order Benchmark's schema; fixed values.
JOB_COLUMNS = {
    "aka_name": "id int, person_id int, name string, imdb_index string, name_pcode_cf string, name_pcode_nf string, surname_pcode string, md5sum string",
    "aka_title": "id int, movie_id int, title string, imdb_index string, kind_id int, production_year int, phonetic_code string, episode_of_id int, season_nr int, episode_nr int, note string, md5sum string",
    "cast_info": "id int, person_id int, movie_id int, person_role_id int, note string, nr_order int, role_id int",
    "char_name": "id int, name string, imdb_index string, imdb_id int, name_pcode_nf string, surname_pcode string, md5sum string",
    "comp_cast_type": "id int, kind string",
    "company_name": "id int, name string, country_code string, imdb_id int, name_pcode_nf string, name_pcode_sf string, md5sum string",
    "company_type": "id int, kind string",
    "complete_cast": "id int, movie_id int, subject_id int, status_id int",
    "info_type": "id int, info string",
    "keyword": "id int, keyword string, phonetic_code string",
    "kind_type": "id int, kind string",
    "link_type": "id int, link string",
    "movie_companies": "id int, movie_id int, company_id int, company_type_id int, note string",
    "movie_info": "id int, movie_id int, info_type_id int, info string, note string",
    "movie_info_idx": "id int, movie_id int, info_type_id int, info string, note string",
    "movie_keyword": "id int, movie_id int, keyword_id int",
    "movie_link": "id int, movie_id int, linked_movie_id int, link_type_id int",
    "name": "id int, name string, imdb_index string, imdb_id int, gender string, name_pcode_cf string, name_pcode_nf string, surname_pcode string, md5sum string",
    "person_info": "id int, person_id int, info_type_id int, info string, note string",
    "role_type": "id int, role string",
    "title": "id int, title string, imdb_index string, kind_id int, production_year int, imdb_id int, phonetic_code string, episode_of_id int, season_nr int, episode_nr int, series_years string, md5sum string",
}


#: The column that tells the rows of a table of the star schema apart; None: there is none.
STAR_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": None}


@cache
def job_schema(table: str) -> T.StructType:
    """Schema of a benchmark table; every column may be null."""
    kinds = {"int": T.IntegerType(), "string": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in (c.split() for c in JOB_COLUMNS[table].split(","))])


def parquet_tables(spark: SparkSession, directory: str) -> Callable[[str], DataFrame]:
    """Lookup of ``<directory>/<table>.parquet``, each read once."""
    return cache(lambda table: spark.read.parquet(f"{directory}/{table}.parquet"))


def csv_tables(spark: SparkSession, directory: str, **dialect) -> Callable[[str], DataFrame]:
    """Lookup of the benchmark's ``<directory>/<table>.csv``; ``dialect`` as ``read_csv`` has it."""
    from weftline.sources.files import read_csv

    return cache(lambda table: read_csv(spark, f"{directory}/{table}.csv", job_schema(table), **dialect))
