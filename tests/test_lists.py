import json

import pytest

from agora.plans import documents, records  # noqa: F401  fills records.QUERIES
from agora.sources import rest


@pytest.mark.parametrize("name", ["src5_rest_lists", "src5_streamed_lists"])
def test_queries_equal_sql(same, name):
    same(records.QUERIES[name], records.SQL[name])


def answers(tmp_path):
    held = {"a": {"items": [1, 2], "pagination": {"next": "a2"}}, "a2": {"items": [], "pagination": {"next": "a3"}}, "a3": {"items": [3], "pagination": {"next": "a"}}, "b": {"items": None}}
    (tmp_path / "held.json").write_text(json.dumps(held))
    return rest._Pages({"urls": "a b", "recorded": str(tmp_path / "held.json")})


def test_offsets_name_the_next_page(tmp_path):
    source = answers(tmp_path)
    at, got = source.initialOffset(), []
    offsets = [at]
    while True:
        rows, after = source.read(at)
        if after == at:
            break
        got += rows
        at = json.loads(json.dumps(after))  # as the offset log keeps it
        offsets.append(at)
    assert got == [("a", "1"), ("a", "2"), ("a", "3")] and [o["a"]["next"] for o in offsets] == ["a", "a2", "a3", ""]
    assert list(source.readBetweenOffsets(offsets[1], offsets[3])) == [("a", "3")] and list(source.readBetweenOffsets(at, at)) == []


def test_client_by_import_name(tmp_path):
    get = rest.client({"client": "agora.sources.rest:folder_client", "pages": str(tmp_path)})
    with pytest.raises(rest.Failed):
        get("nowhere")
    (tmp_path / f"key={rest.address_key('x')}").mkdir()
    (tmp_path / f"key={rest.address_key('x')}" / "part-0.txt").write_text('{"items": []}\n')
    assert get("x") == {"items": []} == rest.client({"client": "agora.sources.rest:folder_client", "pages": f"file://{tmp_path}"})("x")
    with pytest.raises(ModuleNotFoundError):
        rest.client({"client": "no.such.module:f"})


def test_batches_grow_and_are_read_again_alike(tmp_path):
    held = {f"l{i}": {"items": [i], "pagination": {"next": f"l{i + 1}"}} for i in range(1000)} | {"l1000": {"items": [], "pagination": {}}}
    (tmp_path / "held.json").write_text(json.dumps(held))
    source = rest._Pages({"urls": "l0", "recorded": str(tmp_path / "held.json")})
    at, got, offsets = source.initialOffset(), [], []
    while True:
        rows, after = source.read(at)
        if after == at:
            break
        got += [json.loads(x) for _, x in rows]
        offsets.append(at)
        at = json.loads(json.dumps(after))
    assert got == list(range(1000)) and len(offsets) < 15
    assert [json.loads(x) for _, x in source.readBetweenOffsets(offsets[2], offsets[5])] == list(range(2, 16))
