"""JSON documents that many tasks read: equal to reading them whole, wherever splits fall."""
import json
import random

import pytest

from riskloom.sources import documents, events, trade


@pytest.fixture
def split_every(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def at(n):
        spark.conf.set(keys[0], str(n))
        spark.conf.set(keys[1], "1")
    yield at
    for k in keys:
        spark.conf.unset(k)


def rows(n, seed=1):
    rnd = random.Random(seed)
    odd = ['a "quoted" }', "{", "[[", "back\\\\", 'end\\"', "é 日本 😀", "", "}{", "line\nbreak", "\\u0041", "],["]
    return [{"id": i, "name": rnd.choice(odd) * rnd.randint(0, 3), "in": {"deep": [{"x": rnd.choice(odd)}, [i]]}}
            for i in range(n)]


@pytest.mark.parametrize("size", [97, 613])
@pytest.mark.parametrize("indent", [None])
def test_records_at_any_split(spark, tmp_path, split_every, size, indent):
    split_every(size)
    want = rows(6)
    inner = {"type": "F", "crs": {"p": {"a": 1}}, "box": [1, 2], "rows": want, "end": {"z": [3, "]"]}, "start": 5}
    for name, doc, level in (("list", want, 1), ("inner", inner, 2)):
        for n in (1, 2):  # two files of one shape
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"{n}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=n == 1) + "\n" * (n - 1))
        found, outer = documents.records(spark, str(tmp_path / name), level)
        by_file = {}
        for r in sorted(found.collect(), key=lambda r: (r.file, r.position)):
            by_file.setdefault(r.file, []).append(json.loads(r.record))
        assert list(by_file.values()) == [want, want]
        assert found.select("file", "position").distinct().count() == 2 * len(want)
    assert [json.loads(r.outer) for r in outer.collect()] == [{**inner, "rows": []}] * 2


def test_documents_without_records(spark, tmp_path, split_every):
    split_every(13)
    for i, text in enumerate(["", "[]", "{}", '{"rows": []}', '{"rows": [1, "{}"], "a": {"b": {}}}', "  \n"]):
        (tmp_path / f"{i}.json").write_text(text)
    found, _ = documents.records(spark, str(tmp_path), 2)
    assert found.count() == 0


def test_readers_of_one_document(spark, tmp_path, split_every):
    lines = [{"CommodityId": i, "CountryId": i % 7, "Value": i / 8} for i in range(60)]
    doc = {"start": 202501, "rows": lines, "end": 202512}
    (tmp_path / "t.json").write_text(json.dumps(doc))
    feats = [{"type": "Feature", "properties": {"eventtype": "EQ", "eventid": str(i // 2), "name": f"n}} {i}",
              "affectedcountries": [{"iso3": "AAA"}, {"iso3": "BBB"}], "url": {"report": "r"}}} for i in range(60)]
    (tmp_path / "e.json").write_text(json.dumps({"features": feats}, indent=1))
    split_every(700)
    assert trade.read_trade(spark, str(tmp_path / "t.json")).rdd.getNumPartitions() > 1
    got = sorted(map(tuple, trade.read_trade(spark, str(tmp_path / "t.json")).collect()))
    assert got == [(r["CommodityId"], r["CountryId"], r["Value"], 202501, 202512) for r in lines]
    seen = {r.event_id: r.name for r in events.risk_event(events.read(spark, str(tmp_path / "e.json"))).collect()}
    assert seen == {f"GDACS-EQ-{i}": f"n}} {2 * i}" for i in range(30)}
