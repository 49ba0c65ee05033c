import pytest
from pyspark.sql import functions as F

from boxloom.functions import boxes as bx
from boxloom.functions import hashing as hs
from boxloom.functions import numeric as nm
from boxloom.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lit(*v):
    return bx.Box(*[F.lit(float(x)) for x in v])


def values(spark, b):
    return tuple(spark.range(1).select(*b.columns()).first())


@pytest.mark.parametrize("a,b,expected", [
    ((0, 0, 10, 10), (10, 0, 20, 10), 0.0),
    ((0, 0, 10, 10), (5, 0, 15, 10), 1 / 3),
    ((0, 0, 0, 0), (0, 0, 0, 0), 0.0),
])
def test_iou(spark, a, b, expected):
    assert value(spark, bx.box_iou(lit(*a), lit(*b))) == pytest.approx(expected)


def test_restore_translates_without_scaling(spark):
    b = bx.restore_box(lit(100, 200, 300, 500), lit(819, 700, 1843, 1724), F.lit(2000.0), F.lit(2000.0))
    assert values(spark, b) == (919, 900, 1119, 1200)


def test_restore_of_a_box_outside_its_crop_is_null(spark):
    b = bx.restore_box(lit(2000, 0, 2100, 10), lit(0, 0, 1024, 1024), F.lit(4000.0), F.lit(4000.0))
    assert values(spark, b) == (None,) * 4


def test_roi_margin(spark):
    assert values(spark, bx.expand_roi(lit(10, 20, 90, 80), 0.1, F.lit(100), F.lit(90))) == (2, 14, 98, 86)


def test_grid_centres_by_counting(spark):
    for b in [(0, 0, 8, 8), (3.5, 4, 20, 21), (4, 4, 4, 4), (5, 5, 11, 11)]:
        brute = sum(b[0] <= 8 * (i + 0.5) <= b[2] and b[1] <= 8 * (j + 0.5) <= b[3] for i in range(9) for j in range(9))
        assert value(spark, bx.grid_centres(lit(*b), 8)) == brute


def test_polygon_needs_three_points(spark):
    def ring(*pts):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in pts])

    assert value(spark, bx.polygon_area(ring((0, 0), (4, 0), (4, 3)))) == 6
    assert value(spark, bx.polygon_area(ring((0, 0), (4, 0), (0, 0)))) is None


def test_yolo_round_trip(spark):
    y = bx.box_to_yolo(lit(10, 20, 30, 60), F.lit(200.0), F.lit(100.0))
    assert values(spark, bx.box_from_yolo(y["cx"], y["cy"], y["w"], y["h"], F.lit(200.0), F.lit(100.0))) == pytest.approx((10, 20, 30, 60))


def test_hamming_of_negative_codes(spark):
    assert value(spark, hs.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long"))) == 64


def test_git_blob(spark):
    assert value(spark, hs.git_blob_sha(F.encode(F.lit("hello\n"), "UTF-8"))) == "ce013625030ba8dba906f756967f9e9ca394464a"


def test_near_and_finite(spark):
    null = F.lit(None).cast("double")
    assert value(spark, nm.near(null, null)) and not value(spark, nm.near(null, F.lit(1.0)))
    assert not value(spark, nm.is_finite(F.lit(float("nan")))) and not value(spark, nm.is_finite(null))


def test_utc_needs_an_offset(spark):
    assert value(spark, nm.parse_utc(F.lit("2026-09-30T10:00:00"))) is None
    assert value(spark, nm.parse_utc(F.lit("2026-09-30T10:00:00+02:00"))) is not None


@pytest.mark.parametrize("source,name,group", [
    ("rf_embedded_hardware", "STM32_7_MOV-15_jpg.rf.ab12.jpg", "rf_embedded_hardware:video:STM32_7_MOV"),
    ("rf_raspberrypi_vniye", "20240131_101112_x.rf.ff.jpg", "rf_raspberrypi_vniye:capture_day:2024-01-31"),
    ("rf_raspberrypi_vniye", "20241341_101112.jpg", "rf_raspberrypi_vniye:20241341_101112"),
    ("other", "a.b.rf.00.jpg", "other:a.b"),
])
def test_capture_group(spark, source, name, group):
    assert value(spark, tx.capture_group(F.lit(source), F.lit(name))) == group


def test_annotation_name(spark):
    name = F.lit('"Resistor Network" RN4')
    assert (value(spark, tx.source_type(name)), value(spark, tx.source_refdes(name))) == ("resistor network", "RN4")
    assert value(spark, tx.source_refdes(F.lit("ic"))) is None


def test_text_of_markup(spark):
    assert value(spark, tx.plain_text(F.lit("<b>A&amp;B</b> &lt;c&gt;"))) == "A&B <c>"
    assert value(spark, tx.unescape_html(F.lit("&eacute;&#233;"))) == "éé"
