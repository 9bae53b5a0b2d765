import csv
import io
import random

from loomfield.operators import rejects

ROWS = "row_id long, file_id long, row_no int, raw_record string, reason string, cells string"
FILES = "file_id long, has_header boolean, column_names array<string>, column_types array<string>, raw_record string"


def frames(spark, records, types, header=False, file_id=1):
    r = spark.createDataFrame([(n, file_id, n, x, "own", "own") for n, x in enumerate(records, 1)], ROWS)
    f = spark.createDataFrame([(file_id, header, [f"c{n}" for n in range(len(types))], types, "x")], FILES)
    return r, f


def reasons(spark, records, types, **kw):
    r, f = frames(spark, records, types, **kw)
    return dict(sorted((x["row_id"], x["reason"]) for x in rejects.parsed(r, f).collect()))


def test_reasons(spark):
    got = reasons(
        spark,
        ["﻿a,b,c", '1,"x, ""y""",true', "1,x", '1,"x,true', '1,x"y,true', "1.5,x,true", "", "   ", None, ' 7 , "q" , FALSE', ",,", '"1"z,x,true', '1,"two\nlines",True', "+7,x,yes"],
        ["integer", "text", "flag"],
        header=True,
    )
    assert got == {2: None, 3: "columns", 4: "quoting", 5: "quoting", 6: "values", 10: None, 11: None, 12: "quoting", 13: None, 14: "values"}


def test_types(spark):
    days = ["2024-02-29", "2023-02-29", "2024-2-9", " 2024-01-01 ", "", "0000-01-01"]
    assert list(reasons(spark, [f"{d},1" for d in days], ["day", "integer"]).values()) == [None, "values", "values", None, None, "values"]
    numbers = ["1", "-1.5", ".5", "5.", "1e3", "١", "--1", "+0.0"]
    assert list(reasons(spark, [f"x,{d}" for d in numbers], ["text", "decimal"]).values()) == [None, None, "values", "values", "values", "values", "values", None]


def test_delimiters_by_vote(spark):
    for d in ",;\t|":
        records = [d.join(("a", "b,c;d|e" if d not in ",;|" else "b", str(n))) for n in range(5)] + ["torn"]
        r, f = frames(spark, records, ["text", "text", "integer"])
        out = rejects.parsed(r, f).collect()
        assert {x["delimiter"] for x in out} == {d}
        assert [x["reason"] for x in sorted(out, key=lambda x: x["row_id"])] == [None] * 5 + ["columns"]


def test_one_column_and_unknown_file(spark):
    assert reasons(spark, ["1", "2", "x"], ["integer"]) == {1: None, 2: None, 3: "values"}
    r, f = frames(spark, ["1"], ["integer"])
    assert rejects.parsed(r.withColumn("file_id", r["file_id"] + 1), f).count() == 0
    assert rejects.parsed(r.limit(0), f).count() == 0
    assert rejects.parsed(r, f.limit(0)).count() == 0


def test_round_trip_with_the_csv_module(spark):
    random.seed(3)
    cells = ["", "a", 'say "x"', "two\nlines", "b,c", " padded ", "é"]
    made = [[random.choice(cells) for _ in range(4)] for _ in range(200)]
    records = []
    for row in made:
        buffer = io.StringIO()
        csv.writer(buffer, quoting=random.choice([csv.QUOTE_ALL, csv.QUOTE_MINIMAL]), lineterminator="").writerow(row)
        records.append(buffer.getvalue())
    r, f = frames(spark, records, ["text"] * 4)
    out = {x["row_id"]: x for x in rejects.parsed(r, f).collect()}
    for n, row in enumerate(made, 1):
        if records[n - 1].strip():
            assert out[n]["reason"] is None
            assert [c.strip() for c in out[n]["cells"]] == [c.strip() for c in row]


def test_typed_cells(spark):
    r, f = frames(spark, ["7,x,1.5,2024-01-02,true", ",,,,"], ["integer", "text", "decimal", "day", "flag"])
    out = {(x["row_id"], x["column_no"]): x for x in rejects.typed_cells(r, f).collect()}
    assert len(out) == 10
    assert int(out[1, 1]["integer_value"]) == 7 and out[1, 3]["decimal_value"] == 1.5 and str(out[1, 4]["day_value"]) == "2024-01-02" and out[1, 5]["flag_value"] is True
    assert out[2, 1]["integer_value"] is None and out[1, 2]["column_name"] == "c1"
