"""CSV files that many tasks read: records equal to those of one reader, wherever splits fall."""
import csv
import io
import random

import pytest

from riskloom.sources import companies, records, sanctions


@pytest.fixture
def split_every(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def at(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")
    yield at
    for k in keys:
        spark.conf.unset(k)


ODD = ["", "plain", 'a "quoted" word', "line\nbreak", 'end"', "x,y", "\n\n", '"', '""', "é 日本 😀", "a\r\nb", '\n"\n,"']


def table(n, seed):
    rnd = random.Random(seed)
    return [[str(i), *[rnd.choice(ODD) * rnd.randint(0, 2) for _ in range(rnd.randint(2, 5))], "last"]
            for i in range(n)]


def cells(spark, path):
    found = records.read(spark, path).select(companies.csv_cells("line").alias("c")).collect()
    return sorted(r.c for r in found)


@pytest.mark.parametrize("size", [41, 170, 100_000])
def test_records_at_any_split(spark, tmp_path, split_every, size):
    split_every(size)
    want = []
    for n, end in enumerate(("\n", "\r\n")):
        rows = table(25, n)
        out = io.StringIO()
        csv.writer(out, lineterminator=end, quoting=(csv.QUOTE_MINIMAL, csv.QUOTE_ALL)[n]).writerows(rows)
        (tmp_path / f"{n}.csv").write_bytes((b"\xef\xbb\xbf" if n else b"") + out.getvalue().encode())
        want += rows
    assert cells(spark, str(tmp_path)) == sorted(want)


@pytest.mark.parametrize("size", [20, 100_000])
def test_quotes_inside_unquoted_fields_open_nothing(spark, tmp_path, split_every, size):
    split_every(size)
    text = '1,12" PIPES LTD,a\n2,"b ""c""\nd",e"\n3,"f"g"h,"i\n,"\n\n4,,\n'
    (tmp_path / "a.csv").write_text(text)
    lines = sorted(r.line for r in records.read(spark, str(tmp_path)).collect())
    assert lines == ['1,12" PIPES LTD,a', '2,"b ""c""\nd",e"', '3,"f"g"h,"i\n,"', "4,,"]
    parsed = [r for r in csv.reader(io.StringIO(text)) if r]
    assert [r[0] for r in parsed] == ["1", "2", "3", "4"]  # the standard reader cuts alike


def test_open_to_the_end_empty_and_broken_characters(spark, tmp_path, split_every, monkeypatch):
    split_every(16)
    (tmp_path / "0.csv").write_text("")
    (tmp_path / "1.csv").write_bytes(b"a,\xff\xfe,b\n")
    (tmp_path / "2.csv").write_text('c,d\ne,"never closed\n' + "more text, and more\n" * 5)
    got = records.read(spark, str(tmp_path))
    lines = sorted(r.line for r in got.collect())
    assert lines == ["a,��,b", "c,d", 'e,"never closed\n' + "\n".join(["more text, and more"] * 5)]
    assert companies.open_quotes(got).first().value == 1
    monkeypatch.setattr(records, "LONGEST_PIECE", 10)
    with pytest.raises(Exception, match="quotes are open"):
        records.read(spark, str(tmp_path))
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "0.csv").write_text("")
    assert records.read(spark, str(tmp_path / "empty")).count() == 0


def test_readers_of_one_file(spark, tmp_path, split_every):
    rows = [["Report Date: 1"], ["Name", "Unique ID", "Regime Name", "Other", "Designation Type"]] + [
        [f"n\n{i}", f"U{i}", "The X (Sanctions) Regulations", 'a "b"', "" if i % 2 else "Entity"] for i in range(50)]
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows(rows)
    (tmp_path / "s.csv").write_bytes(b"\xef\xbb\xbf" + out.getvalue().encode())
    split_every(300)
    got = sorted(map(tuple, sanctions.read(spark, str(tmp_path / "s.csv")).collect()))
    assert got == sorted((r[1], r[2], r[4] or None) for r in rows[2:])
