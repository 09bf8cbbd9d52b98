import pytest
from pyspark.sql import functions as F

from tagplace.functions import geo, parse


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("line", "fields"), [
    ('1,2,2015-10-01 10:00:00,"{a,b}",5,Name,1.5,2.5', ["1", "2", "2015-10-01 10:00:00", "{a,b}", "5", "Name", "1.5", "2.5"]),
    ("1,2,x,{},5,,1.5,2.5", ["1", "2", "x", "{}", "5", "", "1.5", "2.5"]),
    ('1,2,x,{},5,"",1.5,2.5', ["1", "2", "x", "{}", "5", "", "1.5", "2.5"]),
    ('1,2,x,"{""x y"",b}",5,N,1.5,2.5', []),
    (',a,,"x,y"', ["", "a", "", "x,y"]),
    ("", [""]),
    ("1,2,3", ["1", "2", "3"]),
])
def test_csv_fields(spark, line, fields):
    assert one(spark, line, parse.csv_fields) == fields


@pytest.mark.parametrize(("text", "tags"), [("{a,b}", ["a", "b"]), ("{ new york ,b }", ["newyork", "b"]), ("{}", [""]), ("{a,,b}", ["a", "", "b"]), ("a,b", []), ("{a}{b}", []), ("", [])])
def test_tag_list(spark, text, tags):
    assert one(spark, text, parse.tag_list) == tags


@pytest.mark.parametrize(("text", "terms"), [("Beach+Sun", ["beach", "sun"]), ("a,b+c", ["a", "b", "c"]), ("a+b,,", ["a", "b"]), ("a++b", ["a", "", "b"])])
def test_request_terms(spark, text, terms):
    assert one(spark, text, parse.request_terms) == terms


def test_small_text_functions(spark):
    assert one(spark, "{a b,c}", parse.strip_braces_split) == ["a b", "c"]
    assert one(spark, "12_7", parse.media_key) == 12
    assert one(spark, "x_7", parse.media_key) is None
    assert one(spark, "\x01 a \n", parse.java_trim) == "a"
    assert one(spark, """<a&'b">""", parse.xml_escape) == "&lt;a&amp;&apos;b&quot;&gt;"
    assert str(one(spark, "2015-10-01 10:00:00.5 more", parse.parse_date)) == "2015-10-01 10:00:00"
    assert one(spark, "2015-13-01 10:00:00", parse.parse_date) is None
    assert one(spark, "a b-c", parse.query_terms) == ["a", "b", "c"]
    assert one(spark, "7", parse.kml_color) == one(spark, "7", parse.kml_color)


def test_safe_access(spark):
    df = spark.sql("select named_struct('a', named_struct('b', cast(null as int))) as s union all select null")
    assert [r[0] for r in df.select(parse.safe_access(F.col("s"), 5, "a", "b")).collect()] == [5, 5]


def test_roundtrip(spark):
    rows = [(lat, lon) for lat in (-89.0, -45.5, 0.0, 12.25, 80.0) for lon in (-179.0, 0.0, 77.7)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    x, y, z = geo.lla_to_ecef(F.col("lat"), F.col("lon"))
    back = df.select("lat", "lon", x.alias("x"), y.alias("y"), z.alias("z"))
    la, lo, alt = geo.ecef_to_lla(F.col("x"), F.col("y"), F.col("z"))
    for r in back.select("lat", "lon", la.alias("la"), lo.alias("lo"), alt.alias("alt")).collect():
        assert abs(r.la - r.lat) < 1e-6 and abs(r.lo - r.lon) < 1e-6 and abs(r.alt) < 1e-2


def test_square_dist(spark):
    df = spark.sql("select array(1d, 2d) a, array(4d, 6d) b")
    assert df.select(geo.square_dist(F.col("a"), F.col("b"))).first()[0] == 25
    with pytest.raises(ValueError):
        geo.square_dist([F.lit(1)], [])
