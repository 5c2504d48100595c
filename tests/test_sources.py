import json

import pytest

from brookwell.sources import files


def test_uploads_and_texts(spark, tmp_path):
    for name, content in {"a.TXT": "  hello \n", "b.txt": " \n", "c.exe": "no", "d.pdf": "%PDF"}.items():
        (tmp_path / name).write_text(content)
    found = files.uploads(spark, str(tmp_path))
    assert {r.name for r in found.collect()} == {"a.TXT", "b.txt", "d.pdf"}
    assert [r.text for r in files.plain_texts(found).collect()] == ["hello"]


def test_questions_are_checked(spark, tmp_path):
    one = {"id": 1, "question": "q", "ground_truth": "a", "category": "factual"}
    for name, rows, good in (("good", [one, one | {"id": 2}], True), ("twice", [one, one], False), ("missing", [one, {"id": 2}], False), ("lacks", [{"id": 1}], False)):
        (tmp_path / f"{name}.json").write_text(json.dumps(rows))
        if good:
            assert files.questions(spark, f"{tmp_path}/{name}.json").count() == 2
        else:
            with pytest.raises(ValueError):
                files.questions(spark, f"{tmp_path}/{name}.json")


def test_items_are_separated(spark):
    rows = [(1, 0, "text", "b"), (1, 1, "table", "t"), (1, 2, "text", " "), (1, 3, "text", "a"), (2, 0, "image", None)]
    texts, modal = files.separated(spark.createDataFrame(rows, "doc_id int, pos int, type string, text string"))
    assert [tuple(r) for r in texts.collect()] == [(1, "b\n\na")]
    assert modal.count() == 2
