import csv
import random

import pytest
from pyspark.sql import functions as F

from discursa.functions import fields as fx
from discursa.sources import ragged_csv as rc

A = """username,timestamp,likes,komentar
lantern9,8/3/2024, 05.12.33,31,"rain, then sun"
oakley,19/3/2024, 23.04.10,5,"the ""old"" mill, shut"
pebble,20/3/2024, 00.00.01,0,"upper line
lower line"

quill,"21/3/2024, 16.45.09",140,"fine"
rowan,22/3/2024, 07.30.00,2,
sorrel,22/3/2024, 07.30.00,2
thistle,yesterday,9,"late"
umber,23/3/2024, 12.12.12,many,"count"
vetch,30/2/2024, 12.12.12,3,"no such day"
"""
B = """type,parent_id,username,timestamp,likes,komentar
PARENT,NONE,willow,2/11/2023, 06.01.59,88,"frost"
REPLY,k77,yarrow,3/11/2023, 19.20.21,13,"thaw"
"""


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "A.csv").write_text(A, encoding="utf-8")
    (tmp_path / "B.csv").write_text(B, encoding="utf-8")
    return str(tmp_path)


def test_cases(spark, folder):
    good, bad = rc.read_comments(spark, folder)
    got = {r.id: r for r in good.collect()}
    assert sorted(got) == ["A#2", "A#3", "A#4", "A#6", "A#7", "B#2", "B#3"]
    assert str(got["A#2"].ts) == "2024-03-08 05:12:33" and got["A#2"].text == "rain, then sun"
    assert got["A#3"].text == 'the "old" mill, shut' and got["A#4"].text == "upper line\nlower line"
    assert str(got["A#6"].ts) == "2024-03-21 16:45:09" and got["A#7"].text == ""
    assert [got["B#2"].is_reply, got["B#3"].is_reply] == [False, True]
    assert got["B#3"].username == "yarrow" and got["B#2"].likes == 88
    assert sorted((r.file, r.record_no) for r in bad.collect()) == [("A.csv", n) for n in (8, 9, 10, 11)]
    with pytest.raises(rc.QualityGateError, match="4 records"):
        rc.quality_gate(bad)


def test_file_names_with_odd_characters(spark, tmp_path):
    (tmp_path / "D +e%.csv").write_text(B, encoding="utf-8")
    good, _ = rc.read_comments(spark, str(tmp_path))
    assert {r.post for r in good.collect()} == {"D +e%"}


def test_crlf(spark, tmp_path):
    (tmp_path / "C.csv").write_bytes(A.replace("\n", "\r\n").encode())
    good, bad = rc.read_comments(spark, str(tmp_path))
    assert good.count() == 5 and bad.count() == 4


@pytest.mark.parametrize("split_bytes", ["150", "1000000"])
def test_records_equal_the_csv_module(spark, tmp_path, split_bytes):
    """Random quoting, commas and line breaks, read in splits far smaller than the records."""
    random.seed(7)
    bits = ["a", "b", ",", '"', '""', "\n", '"\n', '",', "x y", ',"', '"\n\n', " ", '5"', "é"]
    expected = {}
    for k in range(3):
        path = tmp_path / f"P{k}.csv"
        body = "".join(
            "".join(random.choice(bits) for _ in range(random.randint(0, 12))) + random.choice(["\n", '"\n'])
            for _ in range(150)
        )
        text = "username,timestamp,likes,komentar\n" + body + 'end"\n"",end"\n'
        path.write_text(text, encoding="utf-8", newline="")
        with open(path, newline="", encoding="utf-8") as handle:
            rows = list(csv.reader(handle))
        if text.count('"') and rows[-1] and rows[-1][-1].endswith("\n"):
            rows = rows[:-1]  # a quote left open at the end of the file
        expected.update({(f"P{k}", n): r for n, r in enumerate(rows, 1) if n > 1})
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = {(r.post, r.record_no): r.fields for r in rc.read_records(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for key, fields in expected.items():
        assert got[key] == fields, key


def test_long_fields_do_not_overflow(spark, tmp_path):
    long = '"' + 'say ""hi"", ' * 50_000 + '"'
    (tmp_path / "L.csv").write_text(
        "username,timestamp,likes,komentar\n" + f"lantern9,8/3/2024, 05.12.33,0,{long}\n" + "," * 30_000 + "\n", encoding="utf-8"
    )
    rows = {r.record_no: r.fields for r in rc.read_records(spark, str(tmp_path)).collect()}
    assert rows[2][-1] == 'say "hi", ' * 50_000 and len(rows[3]) == 30_001


@pytest.mark.parametrize("split_bytes", ["200", "1000000"])
def test_stray_quote_loses_no_rows(spark, tmp_path, split_bytes):
    """Lines behind a quote that never closes are records again; the line with the quote is one too."""
    rows = [f"u{i},8/3/2024, 05.12.33,{i},text {i}" for i in range(60)]
    rows[20] = 'stray,8/3/2024, 05.12.33,1,"never closed'
    rows[9] = 'two,8/3/2024, 05.12.33,1,"a\nb"'
    (tmp_path / "S.csv").write_text("username,timestamp,likes,komentar\n" + "\n".join(rows) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        good, bad = rc.read_comments(spark, str(tmp_path))
        got = {r.id: (r.username, r.text) for r in good.collect()}
        assert bad.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 60 and got["S#11"] == ("two", "a\nb") and got["S#22"] == ("stray", "never closed")
    assert all(got[f"S#{i + 2}"] == (f"u{i}", f"text {i}") for i in range(60) if i not in (9, 20))


def strays(rows, tmp_path, spark, split_bytes="200"):
    (tmp_path / "T.csv").write_text("username,timestamp,likes,komentar\n" + "\n".join(rows) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        good, bad = rc.read_comments(spark, str(tmp_path))
        return {r.id: (r.username, r.text) for r in good.collect()}, [r.fields for r in bad.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("split_bytes", ["200", "1000000"])
@pytest.mark.parametrize("closer", ['"also open', '"a, well ""quoted"" text"'])
def test_quotes_that_close_a_stray_one_lose_no_rows(spark, tmp_path, split_bytes, closer):
    """The rows between keep the number of the stretch, with a part; those behind keep their numbers."""
    rows = [f"u{i},8/3/2024, 05.12.33,{i},text {i}" for i in range(60)]
    rows[9] = 'two,8/3/2024, 05.12.33,1,"a\nb"'
    rows[20] = 'stray,8/3/2024, 05.12.33,1,"never, closed'
    rows[40] = f"closer,8/3/2024, 05.12.33,1,{closer}"
    rows[50] = 'three,8/3/2024, 05.12.33,1,"c\nd\ne"'
    got, bad = strays(rows, tmp_path, spark, split_bytes)
    assert bad == [] and len(got) == 60
    assert got["T#11"] == ("two", "a\nb") and got["T#22"] == ("stray", "never, closed")
    assert all(got[f"T#22.{i - 20}"] == (f"u{i}", f"text {i}") for i in range(21, 40))
    assert got["T#22.20"] == ("closer", closer.strip('"').replace('""', '"'))
    # The stretch counts once, as for any reader that takes quotes at their word.
    assert all(got[f"T#{i - 18}"] == (f"u{i}", f"text {i}") for i in range(41, 60) if i != 50)
    assert got["T#32"] == ("three", "c\nd\ne")


def test_several_strays_and_the_last_one_open(spark, tmp_path):
    rows = [f"u{i},8/3/2024, 05.12.33,{i},text {i}" for i in range(40)]
    for i in (3, 4, 10, 30, 38):
        rows[i] = f'u{i},8/3/2024, 05.12.33,{i},"text {i}'
    got, bad = strays(rows, tmp_path, spark)
    assert bad == [] and sorted(got.values()) == sorted((f"u{i}", f"text {i}") for i in range(40))
    assert len({*got}) == 40


def test_quoted_rows_inside_a_comment_stay_there(spark, tmp_path):
    """A pasted row, and quotes inside a text, make no stretch on their own."""
    rows = ['a,8/3/2024, 05.12.33,1,"see\nb,8/3/2024, 05.12.33,1,pasted\nend"', 'c,8/3/2024, 05.12.33,1,"one\ntwo "three" four"', "d,8/3/2024, 05.12.33,1,last"]
    got, bad = strays(rows, tmp_path, spark)
    assert got["T#2"] == ("a", "see\nb,8/3/2024, 05.12.33,1,pasted\nend") and got["T#4"] == ("d", "last")
    assert sorted(got) == ["T#2", "T#3", "T#4"] and bad == []


def test_numbers_of_parts(spark):
    df = spark.createDataFrame([("p#17",), ("p#17.2",), ("p#x",), ("p#1.5x",)], "id string")
    assert [r[0] for r in df.select(fx.record_number(F.col("id"))).collect()] == [17, 17, None, None]


def test_split_and_join_are_inverse(spark):
    rows = [["a", "b,c", 'd"e', "f\ng", ""], [" x", '"']]
    df = spark.createDataFrame([(r,) for r in rows], "f array<string>")
    assert [r[0] for r in df.select(fx.split_record(fx.join_record(F.col("f")))).collect()] == rows


def test_whole_numbers(spark):
    df = spark.createDataFrame([(x,) for x in [" 12 ", "+3", "1_000", "x1", "", "1.5", "-4"]], "x string")
    assert [r[0] for r in df.select(fx.whole_number(F.col("x"))).collect()] == [12, 3, 1000, None, None, None, -4]


def test_checksums(spark, folder):
    import hashlib

    got = {r.file: r.sha256 for r in rc.file_checksums(spark, folder).collect()}
    assert got == {"A.csv": hashlib.sha256(A.encode()).hexdigest(), "B.csv": hashlib.sha256(B.encode()).hexdigest()}


def test_checksums_of_folders_and_large_files(spark, tmp_path):
    import hashlib

    content = {"a/x y.csv": b"1", "b/x y.csv": b"2", "b/%41#.bin": b"3", "b/large": bytes(range(256)) * 70_000}
    for name, data in content.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = rc.file_checksums(spark, [str(tmp_path / "a"), str(tmp_path / "b")], root=str(tmp_path)).collect()
    assert len(got) == 4
    names = {r.file: r.sha256 for r in got}
    want = {k: hashlib.sha256(v).hexdigest() for k, v in content.items()}
    assert names == want


def test_checksums_open_no_file_in_spark(spark, tmp_path):
    import hashlib

    data = bytes(range(256)) * 20
    (tmp_path / "a b.bin").write_bytes(data)
    (tmp_path / "empty.bin").write_bytes(b"")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)  # Spark's reader refuses to read longer files
    try:
        for path in (str(tmp_path), f"file:{tmp_path}", [f"{tmp_path}/*.bin"]):
            assert [tuple(r) for r in rc.file_checksums(spark, path).collect()] == [("a b.bin", hashlib.sha256(data).hexdigest())]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_checksums_of_other_file_systems_come_whole(spark, folder, monkeypatch):
    want = sorted(map(tuple, rc.file_checksums(spark, folder).collect()))
    monkeypatch.setattr(rc, "PIECEWISE", ())
    assert sorted(map(tuple, rc.file_checksums(spark, folder).collect())) == want and len(want) == 2
