"""Every query of the package over empty tables, and over tables whose values are all null."""

import os

import pytest
from pyspark.sql import functions as F

from lexloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
TABLES = "law_metadata loaded_documents clean_results legal_sections legal_clauses chunks documents review_labels eval_items pack_sizes".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    empty, null = (str(tmp_path_factory.mktemp(n)) for n in ("empty", "null"))
    for name in TABLES:
        df = spark.read.parquet(f"{FOLDER}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
        nothing = df.limit(3).select(*[F.lit(None).cast(t).alias(c) for c, t in df.dtypes])
        (df.limit(2) if name == "pack_sizes" else nothing).coalesce(1).write.parquet(f"{null}/{name}.parquet")
    return empty, null


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_empty_tables(spark, folders, name):
    assert queries.queries()[name](spark, folders[0]).count() == 0


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_values_that_are_all_null(spark, folders, name):
    rows = queries.queries()[name](spark, folders[1]).collect()
    assert not rows or not name.endswith("_found")
