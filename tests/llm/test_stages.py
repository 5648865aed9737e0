"""Each stage of the pipeline against a plain computation on what the stage before has kept."""

import corpus_pipeline
import pytest
import sentencepiece

from agora.llm.queries import MODEL, ORACLES
from agora.llm.shared import table
from test_neardup import brute


@pytest.fixture(scope="module")
def kept(spark, data):
    """(doc_id, text) after each stage but the last, by its name; documents before them."""
    rows = table(spark, data, "documents")
    out = {"documents": sorted((r.doc_id, r.text) for r in rows.collect())}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.cut(stage(spark, rows, data), name)
        out[name] = sorted((r.doc_id, r.text) for r in rows.collect())
    out["encoding"] = {r.doc_id: r.ids for r in corpus_pipeline.encoding(spark, rows, data).collect()}
    return out


def test_quality(kept, duck):
    cursor = duck.execute(ORACLES["op9_quality_rules"])
    names = [c[0] for c in cursor.description]
    good = {r[names.index("doc_id")] for r in cursor.fetchall() if r[names.index("kept")]}
    assert kept["quality_rules"] == [r for r in kept["documents"] if r[0] in good] and len(good) < len(kept["documents"])


def test_lines(kept):
    seen, gone = set(), {}
    lines = {i: (t or "").split("\n") for i, t in kept["quality_rules"]}
    for i in sorted(lines):
        for k in range(len(lines[i]) - 2):
            window = tuple(lines[i][k : k + 3])
            if window in seen:
                gone.setdefault(i, set()).update((k, k + 1, k + 2))
            seen.add(window)
    want = [(i, t if i not in gone else "\n".join(x for k, x in enumerate(lines[i]) if k not in gone[i])) for i, t in kept["quality_rules"]]
    assert kept["line_dedup"] == want and gone


def test_near_duplicates(kept):
    part = brute(kept["line_dedup"], 5)
    want = [r for r in kept["line_dedup"] if part[r[0]][1] == r[0]]
    assert kept["near_dedup"] == want and len(want) < len(kept["line_dedup"])


def test_decontamination(kept, spark, data):
    """Documents that hold an item's words in a row are gone; those that went share at least half of an item's words."""
    items = [r.text.lower().split() for r in table(spark, data, "benchmark").collect()]
    stayed = {i for i, _ in kept["decontamination"]}
    texts = {i: t.lower().split() for i, t in kept["near_dedup"]}
    holds = {i for i, w in texts.items() if any(f" {' '.join(x)} " in f" {' '.join(w)} " for x in items)}
    assert not holds & stayed and stayed <= set(texts) and kept["decontamination"] == [r for r in kept["near_dedup"] if r[0] in stayed]
    for i in set(texts) - stayed:
        assert any(2 * len(set(x) & set(texts[i])) >= len(set(x)) for x in items)


def test_encoding(kept):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL.removeprefix("file:"))
    want = {i: library.encode(t) for i, t in kept["decontamination"]}
    assert {i: list(x) for i, x in kept["encoding"].items()} == want
