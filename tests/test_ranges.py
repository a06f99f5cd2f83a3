"""Records that span lines and ranges, against Spark's own reader and Python's."""

import csv
import json
import random

import pytest

from causeway.sources import ranges, readers

CELLS = ["plain", "", "a,b", 'says "so"', "two\nlines", "\n\n", "x\r\ny", '"', "ü,\n\"é\"", "long " * 300, " pad "]


@pytest.fixture
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield spark
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_records_in_ranges(small_ranges, tmp_path, end):
    spark, rng = small_ranges, random.Random(len(end))
    want = []
    for part in range(2):
        rows = [[f"{part}-{i}", rng.choice(CELLS), rng.choice(CELLS)] for i in range(120)]
        want += [tuple(c or None for c in row) for row in rows]
        with open(tmp_path / f"part{part}.csv", "w", newline="", encoding="utf-8") as out:
            csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows([["id", "a", "b"], *rows])
    frame = ranges.read_quoted_csv(spark, str(tmp_path))
    assert ranges._pieces(spark, str(tmp_path), "\n").rdd.getNumPartitions() > 10
    assert rows_of(frame) == sorted(want, key=repr)


def test_a_cell_longer_than_several_ranges(small_ranges, tmp_path):
    text = "\n".join(f"line {i} with, commas" for i in range(400))
    with open(tmp_path / "one.csv", "w", newline="") as out:
        csv.writer(out).writerows([["id", "a"], ["1", text], ["2", "end"], ["3", text], ["4", ""]])
    got = rows_of(ranges.read_quoted_csv(small_ranges, str(tmp_path / "one.csv")))
    assert got == [("1", text), ("2", "end"), ("3", text), ("4", None)]


def test_pairs_are_the_rows_of_sparks_reader(small_ranges, tmp_path):
    spark, rng = small_ranges, random.Random(3)
    names = ["extra", *readers.PAIR_COLUMNS]
    rows = []
    for i in range(150):
        number = rng.choice(["1", "2.0", "", "1"])
        rows.append(["x", "altlex", f"d{i}", str(i), number, rng.choice(CELLS).replace("\r", "") + "t", f"<ARG0>a\n</ARG0>{i}", "1", number, "1"])
    with open(tmp_path / "pairs.csv", "w", newline="") as out:
        csv.writer(out).writerows([names, *rows])
    path = str(tmp_path / "pairs.csv")
    cells = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path).select(*readers.PAIR_COLUMNS)
    typed = [
        readers.whole_number(cells[n]).alias(n) if kind == "bigint" else cells[n] for n, kind in readers.PAIR_COLUMNS.items()
    ]
    assert rows_of(readers.read_pairs_csv(spark, path)) == rows_of(cells.select(*typed))


def test_header_only_and_empty_lines(small_ranges, tmp_path):
    (tmp_path / "a.csv").write_text("id,a\n\n\n1,x\n\n")
    (tmp_path / "b.csv").write_text("id,a")
    assert rows_of(ranges.read_quoted_csv(small_ranges, str(tmp_path))) == [("1", "x")]


def test_the_cut_is_narrow_and_moves_torn_records_only(spark, tmp_path):
    with open(tmp_path / "a.csv", "w", newline="") as out:
        csv.writer(out).writerows([["id", "a"], ["1", "x\ny"]])
    plan = ranges.read_quoted_csv(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "multiLine" not in plan.split("FileScan")[1]
    assert plan.count("MapInArrow") == 2 and "FileScan text" in plan and "FileScan csv" not in plan


STRINGS = ["", "a", 'q"q', "b\\", "{[", "]}", '}"', "x\ny", "é}", "\\\"", "instances"]


def document(rng, n):
    def text():
        return rng.choice(STRINGS) * rng.randint(1, 3)

    def instance(i):
        return {"index": str(i), "events": [text() for _ in range(rng.randint(0, 4))], "note": {"deep": [{"x": text()}]},
                "short_contexts": [text() * 20], "label": rng.randint(0, 1)}

    members = {"about": {"instances": [{"index": "no"}]}, "others": [{"index": "never", "x": [{"y": text()}]}] * 30}
    before = rng.random() < 0.5
    instances = {"instances": [instance(i) for i in range(n)]}
    return {**members, **instances} if before else {**instances, **members}


@pytest.mark.parametrize("indent", [None, 1])
def test_one_document_in_many_ranges(small_ranges, tmp_path, indent):
    spark, rng = small_ranges, random.Random(indent)
    want = []
    for k in range(3):
        documents = [document(rng, n) for n in (80, k)]
        (tmp_path / f"{k}.json").write_text("\n".join(json.dumps(d, indent=indent, ensure_ascii=k > 0) for d in documents))
        want += [
            (i["index"], i["events"], i["short_contexts"], i["label"]) for d in documents for i in d["instances"]
        ]
    assert ranges._pieces(spark, str(tmp_path), "}").rdd.getNumPartitions() > 10
    got = readers.read_instances(spark, str(tmp_path)).select("index", "events", "short_contexts", "label")
    assert rows_of(got) == sorted(want, key=repr)


def test_an_element_longer_than_several_ranges(small_ranges, tmp_path):
    one = {"index": "1", "events": ["{}" * 3000], "short_contexts": [], "label": 1}
    two = {"index": "2", "events": ["e"], "short_contexts": ["} \\"], "label": 0}
    (tmp_path / "a.json").write_text(json.dumps({"instances": [one, two, one]}))
    got = rows_of(readers.read_instances(small_ranges, str(tmp_path)))
    assert got == sorted([tuple(x[k] for k in ("index", "events", "short_contexts", "label")) for x in (one, two, one)], key=repr)


def test_no_instances(small_ranges, tmp_path):
    (tmp_path / "a.json").write_text('{"instances": []}')
    (tmp_path / "b.json").write_text('{"other": 1}\n')
    (tmp_path / "c.json").write_text("")
    assert readers.read_instances(small_ranges, str(tmp_path)).count() == 0


def test_cells_are_parsed_once_for_each_record(spark, tmp_path):
    with open(tmp_path / "pairs.csv", "w", newline="") as out:
        csv.writer(out).writerows([["x", *readers.PAIR_COLUMNS], ["x", "c", "d", "1", "0", "t", "m", "1", "n/a", "1"]])
    for read in (readers.read_pairs_csv, readers.pairs_quarantine):
        frame = read(spark, str(tmp_path / "pairs.csv"))
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_csv") == 1
    assert [r["reason"] for r in readers.pairs_quarantine(spark, str(tmp_path / "pairs.csv")).collect()] == ["number"]
