import json
import random
import zipfile

import pytest

from agora.plans import documents, records  # noqa: F401  fills records.QUERIES
from agora.sources import archives, crawl, files


@pytest.mark.parametrize("name", ["src2_zipped_json", "src3_first_archive"])
def test_queries_equal_sql(same, name):
    same(records.QUERIES[name], records.SQL[name])


def pack(path, held, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, value in held:
            z.writestr(name, value)
    return str(path)


def test_only_wanted_entries_are_decoded(spark, tmp_path):
    a = pack(tmp_path / "a.zip", [("x/", ""), ("x/1.json", "one"), ("x/2.json", "two é"), ("y/1.json", "again"), ("3.txt", "no")])
    b = pack(tmp_path / "b.zip", [(f"{i}.json", f"b{i}") for i in range(200)], zipfile.ZIP_STORED)
    seen = spark.sparkContext.accumulator(0)
    wanted = spark.createDataFrame([(1,), (2,), (3,), (7,), (999,), (7,)], "member int")
    got = sorted((r.member, r.archive, r.value) for r in crawl.first_archive(spark, [a, b], wanted, decoded=seen).collect())
    assert got == [("1", 0, "one"), ("2", 0, "two é"), ("3", 1, "b3"), ("7", 1, "b7"), ("999", -1, None)] and seen.value == 4
    assert [tuple(r) for r in crawl.first_archive(spark, [], wanted.limit(1)).collect()] == [("1", -1, None)]


def test_first_json_of_each_archive(spark, tmp_path):
    pack(tmp_path / "a.zip", [("n.txt", "x"), ("m.json", json.dumps([{"k": i, "v": "é" * i} for i in range(50)])), ("z.json", '[{"k": -1}]')])
    pack(tmp_path / "b.zip", [("one.json", ' {"k": 99} ')])
    pack(tmp_path / "c.zip", [("none.txt", "")])
    seen = spark.sparkContext.accumulator(0)
    rows = files.zipped_json(spark, str(tmp_path), "k int, v string", seen).collect()
    assert sorted(r.k for r in rows) == [*range(50), 99] and {r.v for r in rows if r.k == 3} == {"ééé"} and seen.value == 2


@pytest.mark.parametrize("piece", [1, 3, 1000])
def test_elements_do_not_depend_on_pieces(piece):
    rng = random.Random(piece)
    value = [rng.choice([None, True, 12.5, 10**12, "é\\\"]", {"a": [1, {"b": "中文"}]}, [], [[2]], "x" * 300]) for _ in range(200)]
    for array, indent in ((value, None), (value, 1), ([], None)):
        raw = json.dumps(array, indent=indent, ensure_ascii=False).encode()
        assert [json.loads(x) for x in archives.elements(iter([raw[i : i + piece] for i in range(0, len(raw), piece)]))] == array
    assert list(archives.elements(iter([b"12", b"34 "]))) == ["1234"] and list(archives.elements(iter([b" "]))) == []
    with pytest.raises(ValueError):
        list(archives.elements(iter([b"[1, 2"])))


def test_damage_and_places_beyond_two_gigabytes(spark, tmp_path):
    path = tmp_path / "big.zip"
    with open(path, "wb") as f:  # a sparse file: entries after 2.5 GB of nothing
        f.truncate(2_500_000_000)
        f.seek(2_500_000_000)
        with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("m.json", "[1]" * 1000)
    listed = archives.directory(spark.createDataFrame([(str(path),)], "archive string"))
    assert [(r.name, r["at"]) for r in listed.collect()] == [("m.json", 2_500_000_000)]
    assert archives.texts(listed, ["name"]).collect()[0].value == "[1]" * 1000
    small = tmp_path / "s.zip"
    pack(small, [("m.json", "a" * 1000)], zipfile.ZIP_STORED)
    raw = bytearray(small.read_bytes())
    raw[100] ^= 1
    small.write_bytes(raw)
    with pytest.raises(Exception, match="damaged"):
        archives.texts(archives.directory(spark.createDataFrame([(str(small),)], "archive string")), ["name"]).collect()
