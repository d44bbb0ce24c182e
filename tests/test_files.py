"""Files and tables as they are found in the wild."""

from __future__ import annotations

import json

from checks.tables_and_streams import packed
from docsluice.schema import FEATURE_NAMES
from docsluice.sources.files import extract_documents, scan_files
from docsluice.sources.tables import (
    import_ground_truth,
    read_examples,
    read_feedback,
    read_labelled_names,
)

FEATURES = dict(zip(FEATURE_NAMES, [3, 1, 4.5, 0.1, 0.0, False, True, "pdf", "x.org", False, True]))


def test_folder_with_mixed_files(spark, tmp_path):
    import pandas as pd

    docx = next(packed([pd.DataFrame({"doc_id": [1], "text": ["first\nsecond"]})])).content[0]
    (tmp_path / "plain.txt").write_bytes("  Grüße\r\nzwei ".encode())
    (tmp_path / "old.MD").write_bytes(b"latin \xe9")
    (tmp_path / "note.md").write_bytes(b"latin \xe9")
    (tmp_path / "good.docx").write_bytes(docx)
    (tmp_path / "broken.docx").write_bytes(docx[:50])
    (tmp_path / "page.pdf").write_bytes(b"%PDF")
    (tmp_path / "picture.png").write_bytes(b"png")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "hidden.txt").write_text("not read")
    found = {r.path.rsplit("/", 1)[1]: r for r in extract_documents(scan_files(spark, [str(tmp_path)])).collect()}
    assert set(found) == {"plain.txt", "note.md", "good.docx", "broken.docx", "page.pdf"}
    assert (found["plain.txt"].content, found["plain.txt"].file_extension) == ("Grüße\nzwei", "txt")
    assert found["note.md"].content == "latin é"
    assert (found["good.docx"].content, found["good.docx"].error) == ("first\nsecond", None)
    assert found["broken.docx"].content is None and found["broken.docx"].error.startswith("Failed to extract")
    assert found["page.pdf"].error == "no extractor for this file type"
    assert found["plain.txt"].file_size == len("  Grüße\r\nzwei ".encode())
    own = extract_documents(scan_files(spark, [f"{tmp_path}/*.pdf"]), {"pdf": lambda data: data.decode().lower()})
    assert [r.content for r in own.collect()] == ["%pdf"]


def test_labelled_names(spark, tmp_path):
    (tmp_path / "names.csv").write_text('filename,label\n"a,b.pdf",memo\nc.txt,form\n')
    assert sorted(map(tuple, read_labelled_names(spark, str(tmp_path)).collect())) == [("a,b.pdf", "memo"), ("c.txt", "form")]


def test_feedback_lines(spark, tmp_path):
    good = {"type": "performance_feedback", "routing_decision": "ML", "features": FEATURES, "ml_correct": True}
    lines = [
        json.dumps({**good, "ml_confidence": 0.25, "actual_category": "memo"}),
        "{broken",
        "",
        json.dumps({"type": "user_correction", "correct_category": "form"}),
        json.dumps({**good, "routing_decision": "LLM", "cost_llm": 0.5}),
        json.dumps({**good, "routing_decision": "other"}),
        json.dumps({**good, "ml_confidence": 0.75}),
    ]
    (tmp_path / "feedback.jsonl").write_text("\n".join(lines) + "\n")
    path = str(tmp_path / "feedback.jsonl")
    found = {(r.routing_decision, r.ml_confidence, r.cost_ml, r.cost_llm) for r in read_feedback(spark, path).collect()}
    assert found == {("ML", 0.25, 0.001, 0.01), ("LLM", 0.5, 0.001, 0.5), ("ML", 0.75, 0.001, 0.01)}
    assert read_feedback(spark, path, limit=5).count() == 2
    assert read_feedback(spark, path, limit=0).count() == 3


def test_whole_file_shapes(spark, tmp_path):
    (tmp_path / "examples.json").write_text(
        json.dumps([{"features": FEATURES, "routing_decision": "ML", "ml_confidence": 0.5}] * 2, indent=2)
    )
    found = read_examples(spark, str(tmp_path / "examples.json"), whole_file=True).collect()
    assert [(r.routing_decision, r.features.file_extension, r.cost_llm) for r in found] == [("ML", "pdf", 0.01)] * 2
    truth = {
        "k1": {"content": "c", "metadata": {"file_size": 3}, "true_category": "memo", "timestamp": 1.5},
        "k2": {"content": "d", "metadata": None, "true_category": "form", "confidence_score": 0.5, "source": "manual"},
    }
    (tmp_path / "truth.json").write_text(json.dumps(truth, indent=2))
    rows = {r.content_hash: r for r in import_ground_truth(spark, str(tmp_path / "truth.json")).collect()}
    assert (rows["k1"].metadata.file_size, rows["k1"].confidence_score, rows["k1"].source) == (3, 1.0, "unknown")
    assert (rows["k2"].metadata, rows["k2"].confidence_score, rows["k2"].source) == (None, 0.5, "manual")
