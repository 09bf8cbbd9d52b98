"""Queries on the smallest tables with documents that have no words equal their SQL twins."""

import os

import duckdb
import pytest
from test_queries import SQL, rows

from tagplace.jobs import queries
from tagplace.sources import media


@pytest.fixture(scope="module")
def odd(sf, tmp_path_factory):
    root = tmp_path_factory.mktemp("odd")
    c = duckdb.connect()
    more = "select 1000 + i, t, 'en', 'src' || i, length(t) from (values (1, ''), (2, '12 34 ...'), (3, '{}')) v(i, t)"
    for t in os.listdir(sf):
        name = t.removesuffix(".parquet")
        if name == "documents":
            c.execute(f"copy (select * from '{sf}/{t}' union all {more}) to '{root}/{t}'")
        else:
            os.symlink(f"{sf}/{t}", root / t)
        c.execute(f"create view {name} as select * from '{root}/{t}'")
    return str(root), c


@pytest.mark.parametrize("name", ["class_frequency", "class_tag_counts", "class_model_files", "insert_coordinates", "cluster_csv"])
def test_documents_without_words(spark, odd, name):
    root, duck = odd
    assert rows(queries.queries()[name](spark, root).toPandas()) == rows(duck.execute(SQL[name]).df())


def test_cluster_csv_tells_empty_from_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"",1.5,2.5,c1\n2,,1.5,,c2\n3,"a,b",,2.5,\n')
    got = media.read_cluster_csv(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == [("", 1.5, 2.5, "c1"), ("a,b", None, 2.5, None), (None, 1.5, None, "c2")]


def test_few_centres_have_cells_without_rings(spark):
    from tagplace.operators import cells
    from tagplace.sources import kml

    centers = spark.createDataFrame([(1, 6.4e6, 0.0, 0.0), (2, 0.0, 6.4e6, 0.0), (3, 0.0, 6.4e6, 0.0)], "label int, x double, y double, z double")
    made = cells.cells_of(centers)
    assert [(r.label, round(r.lat), round(r.lon), r.ring) for r in made.orderBy("label").collect()] == [(1, 0, 0, None), (2, 0, 90, None), (3, 0, 90, None)]
    assert made.schema["ring"].dataType == cells.cell_polygons(spark.createDataFrame([(i, *[float(j == i) if i < 3 else -1.0 for j in range(3)]) for i in range(4)], centers.schema)).schema["ring"].dataType
    assert kml.cells_kml(made).count() == 2
