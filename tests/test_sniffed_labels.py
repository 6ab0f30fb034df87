"""Label files of unknown kind."""

from annolens.sources import labels


def rows(df):
    return sorted(((r.path, r.kind, r.status, r.cls, r.x and round(r.x, 6), r.w and round(r.w, 6), r.points and [tuple(p) for p in r.points]) for r in df.collect()), key=repr)


def lines(spark, files):
    return spark.createDataFrame([(k, v) for k, some in files.items() for v in some], "path string, value string")


def test_boxes_and_polygons(spark):
    files = {
        "boxes": ["0 0.5 0.5 0.2 0.2", "0 0.5 0.5 0.2 0.2", "1 1.01 0.5 0.2 0.2", ""],
        "polygons": ["0 0 0 1 0 1 1", "1 0.2 0.2 0.4 0.2 0.4 0.6 0.2 0.6"],
        "mixed": ["0 0.5 0.5 0.2 0.2", "1 0 0 1 0 1 1"],
        "six": ["0 0.5 0.5 0.2 0.2 0.9"],
        "class": ["2 0.5 0.5 0.2 0.2"],
        "far": ["0 1.02 0.5 0.2 0.2"],
        "word": ["0 a 0.5 0.2 0.2"],
        "blank": ["  "],
    }
    got = rows(labels.sniffed(lines(spark, files), 2))
    assert [r[:5] for r in got if r[0] == "boxes"] == [("boxes", "boxes", "found", 0, 0.5), ("boxes", "boxes", "found", 1, 1.01)]
    assert [r[3:] for r in got if r[0] == "polygons"] == [(0, 0.5, 1.0, [(0, 0, 1), (1, 0, 1), (1, 1, 1)]), (1, 0.3, 0.2, [(0.2, 0.2, 1), (0.4, 0.2, 1), (0.4, 0.6, 1), (0.2, 0.6, 1)])]
    assert [r[3:6] for r in got if r[0] == "mixed"] == [(0, 0.35, 0.3), (1, 0.5, 1.0)]  # beside a polygon, four numbers are two points
    assert {r[0]: r[2] for r in got} == {"boxes": "found", "polygons": "found", "mixed": "found", "six": "corrupt", "class": "corrupt", "far": "corrupt", "word": "corrupt"}
    assert all(r[3:] == (None, None, None, None) for r in got if r[2] == "corrupt")


def test_keypoints(spark):
    files = {"two": ["0 0.5 0.5 0.2 0.2 0.1 0.2 -0.005 0.4"], "short": ["0 0.5 0.5 0.2 0.2 0.1 0.2"]}
    got = rows(labels.sniffed(lines(spark, files), 1, (2, 2)))
    assert got[1][2:] == ("found", 0, 0.5, 0.2, [(0.1, 0.2, 1), (-0.005, 0.4, 0)]) and got[0][2] == "corrupt"
    three = labels.sniffed(lines(spark, {"a": ["0 0.5 0.5 0.2 0.2 0.1 0.2 2 0.3 0.4 0"]}), 1, (2, 3))
    assert rows(three)[0][6] == [(0.1, 0.2, 2), (0.3, 0.4, 0)]
